import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

PROSE = "the quick brown fox jumps over the lazy dog while seven old wizards make toxic brew for the evil queen and her jovial friends under a pale moon near the quiet river bank where nobody ever goes after dark because of the fog"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, bin int, rid int, shard int, fp string, block_id long, row string, digest string, score double, rest long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties, and columns named like those the operators use inside."""
    words = PROSE.split()
    texts = {
        0: PROSE, 1: None, 2: "", 3: " \t\n\x0b", 4: PROSE + " " + PROSE, 5: "short", 6: "Ünïcödé wörds — mit Umlauten und ß", 7: "12345 67890 !!", 8: PROSE, 9: " ".join(words[::-1]),
        10: "\n".join(f"line {i} of a rather long text with {words[i % len(words)]} in it" for i in range(3000)), 11: "a" * 300, 12: "x y z\x1cw",
    }
    rows = [(d, t) for d, t in texts.items()] + [(8, PROSE), (8, PROSE), (None, "no id here " + PROSE), (None, None), (20, PROSE.upper())]
    out = []
    for i, (d, t) in enumerate(rows):
        out.append((d, t, ["en", "de", "fr", None][i % 4], ["a", "b", None, "c"][i % 4], len(t) if t else None, i, "k", 1, 2, 3, "f", 4, "r", "d", 0.5, 7))
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
