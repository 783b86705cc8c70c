import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the ing and ion er of thou wh ent ly".split(), "de": "der sch ein ung ich auf ä tz keit pf".split(), "fr": "le eau ou é que ç tion ê aux eux".split()}


def words(rng, n, lang="en"):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with families of near copies, exact copies, shared passages, nulls, blanks, tiny and long texts, and repeated rows."""
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        lang = rng.choice(["en", "en", "de", "fr"])
        lines = [" ".join(words(rng, rng.randint(3, 30), lang)).capitalize() + rng.choice([".", "!", ""]) for _ in range(rng.randint(1, 6))]
        texts.append(("\n".join(lines), lang))
    for base in rng.sample(texts, 4):
        for _ in range(25):  # a family: some link directly, some by others, some not at all
            w = base[0].split(" ")
            for _ in range(max(1, len(w) // rng.choice([14, 25, 50, 100]))):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 1, base[1]))
            texts.append((" ".join(w), base[1]))
    passage = " ".join(words(rng, 55))
    texts += [(" ".join(words(rng, rng.randint(5, 60))) + "\n" + passage, "en") for _ in range(15)]
    texts += [texts[3]] * 6 + [texts[7]] * 2
    texts += [(None, "en"), ("", None), (" \n\t ", "en"), ("one", "en"), ("One", None), ("one two three four", "de"), ("12 34 !!", None), ("a\x0bb\x0cc d e f", "en"), (" ".join(words(rng, 9000)), "en"), ("😀 ß İstanbul ſ", "fr")]
    rng.shuffle(texts)
    rows = [(7 * i + 3, t, lang, f"src{rng.choice([0, 0, 0, 1, 2, 11, 12])}" if i % 37 else None, len(t or "")) for i, (t, lang) in enumerate(texts)]
    rows += [rows[4], rows[9]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(corpus, SCHEMA).repartition(5, "n_chars").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(spark, docs):
    """The documents with further columns whose names operators might use."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(1).alias(c) for c in ("score", "lang_pred", "k", "s", "fp", "epoch_", "times_", "same_", "turn_", "gone_", "removed_", "of_", "Bucket_", "component")])
