"""The rubric scorers against their SQL where a first turn has no word, so that lists of the rubric hold an empty item."""

import duckdb
import pytest
from compare import same

from palimpsest import catalog


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    first = ["éoi ça où", "", "Hier word", None]
    rows = [(c, t, "user", text) for c in range(400) for t, text in enumerate([first[c % 4 if c % 3 else 0], ["una word", "the éoi x", None][c % 3], "the memory"][: 3 - c % 2])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.mode("overwrite").parquet(str(folder / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return str(folder), con


def test_an_empty_item_of_a_list_is_in_every_answer(spark, odd):
    rows = same(catalog.QUERIES["K6_rubric_score"](spark, odd[0]), odd[1], catalog.ORACLE["K6_rubric_score"])
    score = {c: s for c, s, _ in rows}
    assert score[1] == 1.0 and {r[2] for r in rows} == {"scored", "needs_judge", "errored"}  # of conversation 1 the rules are The and the empty item


def test_an_empty_forbidden_item_is_an_escape(spark, odd):
    rows = same(catalog.QUERIES["K7_stale_escape"](spark, odd[0]), odd[1], catalog.ORACLE["K7_stale_escape"])
    escaped = dict(rows)
    assert escaped[25] is True and {r[1] for r in rows} == {True, False, None}  # conversation 25 forbids the empty item and una, which it does not say
