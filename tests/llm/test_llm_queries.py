import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import DATA, duck, duck_rows, spark_rows  # noqa: E402

from tarnbeck.llm import queries  # noqa: E402

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, str(SF))) == duck_rows(duck(SF), queries.ORACLE[name])


@pytest.mark.parametrize(
    "name, columns",
    [("p2_found", ["src", "record_id", "entry_id"]), ("p4_found", ["src", "item_id"]), ("p5_found", ["src", "record_id"]), ("p7_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id"])],
)
def test_columns_and_rows(spark, name, columns):
    df = queries.QUERIES[name](spark, str(SF))
    assert df.columns == columns and df.count() == df.distinct().count() > 0


def test_pieces_of_the_corpus_cover_it(spark):
    out = queries.QUERIES["p4_pieces"](spark, str(SF))
    text = {r["block_id"]: r["text_raw"] for r in spark.read.parquet(str(SF / "content_block.parquet")).collect() if r["text_raw"]}
    end = {}
    for r in sorted(out.where("src = 'content_block'").collect(), key=lambda r: (r["item_id"], r["piece_no"])):
        assert text[r["item_id"]][r["start"] : r["start"] + len(r["piece"])] == r["piece"] and len(r["piece"]) <= 1200
        assert r["start"] == (end[r["item_id"]] - 120 if r["item_id"] in end else 0)
        end[r["item_id"]] = r["start"] + len(r["piece"])
    assert end and all(n == len(text[k]) for k, n in end.items())
