import os
import tempfile

from pyspark.sql import functions as F

from corpuslab.sources import files as fl
from corpuslab.sources.profile import profile
from corpuslab.sources.tables import SCHEMAS, read_table
from corpuslab.streaming.pages import stream_articles

from .conftest import SMALL


def _labels(spark):
    return read_table(spark, SMALL, "labels")


def _rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "quality", "toxic").collect())


def test_jsonl_and_column_json_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="corpuslab-io-")
    want = _rows(_labels(spark))
    p1 = fl.write_json(_labels(spark), os.path.join(base, "jsonl"))
    assert _rows(fl.read_jsonl(spark, p1, SCHEMAS["labels"])) == want
    p2 = fl.write_json_columns(_labels(spark).repartition(3), os.path.join(base, "cols"), "doc_id")
    assert _rows(fl.read_json_columns(spark, p2, SCHEMAS["labels"])) == want


def test_csv_with_index(spark):
    base = tempfile.mkdtemp(prefix="corpuslab-io-")
    p = fl.write_csv(_labels(spark), os.path.join(base, "csv"), index_key="doc_id")
    back = spark.read.option("header", True).option("inferSchema", True).csv(p)
    rows = sorted(back.collect(), key=lambda r: r["index"])
    assert [r["index"] for r in rows] == list(range(len(rows)))
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


HARD = [(1, 'quote " and "" \\" end', 1.5), (2, "line\nbreak\r\nand\rmore", None), (3, "", 2.0), (4, None, 0.0),
        (5, "  outer blanks\t", -1.0), (6, "comma, semi; 'x'", 3.0), (7, "\\", 4.0), (8, '"', 5.0), (9, "a\n\n", 6.0),
        (1 << 62, "sparse key é 😀", 7.0), (-5, "negative", 8.0)]
HARD_SCHEMA = "doc_id long, text string, x double"


def _same(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_csv_keeps_text(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame(HARD, HARD_SCHEMA)
    p = fl.write_csv(df, os.path.join(tempfile.mkdtemp(prefix="corpuslab-io-"), "csv"), index_key="doc_id")
    schema = T.StructType([T.StructField("index", T.LongType()), *df.schema.fields])
    back = fl.read_csv(spark, p, schema)
    assert _same(back.drop("index")) == sorted(HARD)
    assert [r["doc_id"] for r in back.orderBy("index").collect()] == sorted(r[0] for r in HARD)


def test_json_columns_keep_text_and_nulls(spark):
    df = spark.createDataFrame(HARD, HARD_SCHEMA)
    p = fl.write_json_columns(df, os.path.join(tempfile.mkdtemp(prefix="corpuslab-io-"), "cols"), "doc_id", rows_per_object=3)
    assert _same(fl.read_json_columns(spark, p, df.schema).drop("row_id")) == sorted(HARD)


def test_json_columns_indented_and_broken(spark):
    import json

    import pytest
    base = tempfile.mkdtemp(prefix="corpuslab-io-")
    schema = _labels(spark).schema
    with open(os.path.join(base, "a.json"), "w") as f:
        json.dump({"doc_id": {"0": 7, "1": 8}, "quality": {"0": 1, "1": None}, "toxic": {"0": 0, "1": 1}}, f, indent=2)
    assert _rows(fl.read_json_columns(spark, base, schema).fillna(-1)) == [(7, 1, 0), (8, -1, 1)]
    with open(os.path.join(base, "b.json"), "w") as f:
        f.write("{ not json")
    with pytest.raises(Exception):
        fl.read_json_columns(spark, base, schema).collect()


def test_one_json_object_is_read_by_many_tasks(spark):
    """One object of a few hundred KB with small splits: escaped quotes, backslashes, braces
    inside strings, nested values, nulls and missing cells, on one line and indented."""
    import json
    import random
    rng = random.Random(9)
    texts = ['say "hi"', "back\\slash\\", '\\"', "{braces} [and] , : colons", "", 'tail"', "é 😀 \n\t", '\\\\"x']
    n = 3000
    obj = {"text": {str(i): rng.choice(texts) + str(i) if i % 11 else None for i in range(n)},
           "x": {str(i): i / 4 for i in range(n) if i % 7}, "more": {str(i): {"a": [i, {"b": "}"}], "c": 'q"'} for i in range(0, n, 5)},
           "empty": {}, "flag": {str(i): i % 2 == 0 for i in range(n)}}
    schema = "text string, x double, more string, empty string, flag boolean"
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(schema)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 * 1024))
    try:
        for indent in (None, 2):
            path = os.path.join(tempfile.mkdtemp(prefix="corpuslab-io-"), "one.json")
            with open(path, "w") as f:
                json.dump(obj, f, indent=indent, ensure_ascii=indent is None)
            assert spark.read.option("lineSep", '"').text(path).rdd.getNumPartitions() > 5
            rows = {r["row_id"]: r for r in fl.read_json_columns(spark, path, schema).collect()}
            assert len(rows) == n
            for i in range(n):
                r = rows[str(i)]
                assert (r["text"], r["x"], r["flag"]) == (obj["text"][str(i)], obj["x"].get(str(i)), i % 2 == 0)
                more = obj["more"].get(str(i))
                assert (json.loads(r["more"]) if r["more"] else None) == more and r["empty"] is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_objects_fail(spark):
    import pytest
    schema = _labels(spark).schema
    for text in ['[1, 2]', '{"doc_id": 3}', '{"doc_id": {"0": 1}', '{"doc_id": {"0": "x}}', '{"a": {"0": 1}} {', '"text"', '{"a": {"0": 1}, "b"}']:
        base = tempfile.mkdtemp(prefix="corpuslab-io-")
        with open(os.path.join(base, "b.json"), "w") as f:
            f.write(text)
        with pytest.raises(Exception):
            fl.read_json_columns(spark, base, schema).collect()
    base = tempfile.mkdtemp(prefix="corpuslab-io-")
    for name, text in (("a", " \n"), ("b", "{}"), ("c", '{"doc_id": {}}'), ("d", '{"doc_id": {"0": 5}}')):
        with open(os.path.join(base, f"{name}.json"), "w") as f:
            f.write(text)
    assert [r["doc_id"] for r in fl.read_json_columns(spark, base, schema).collect()] == [5]


def test_range_rank_on_sparse_and_skewed_keys(spark):
    import random

    from corpuslab.operators.rank import range_rank
    rng = random.Random(1)
    rows = [(rng.randrange(-2**62, 2**62), "th" + str(i) if i % 10 else "zz") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, w string")
    got = [r["rank"] for r in range_rank(df, [F.col("k").asc()]).orderBy("k").collect()]
    assert got == list(range(1, len(rows) + 1))
    got = range_rank(df, [F.col("w").asc(), F.col("k").asc()], start=0).orderBy("w", "k").collect()
    assert [r["rank"] for r in got] == list(range(len(rows)))


def test_word_vectors_last_wins(spark):
    base = tempfile.mkdtemp(prefix="corpuslab-io-")
    path = os.path.join(base, "vec.txt")
    with open(path, "w") as f:
        f.write("cat 0.1 0.2\ndog 0.3 0.4 \ncat 0.5 0.6\n")
    got = {r["word"]: [round(x, 3) for x in r["vec"]] for r in fl.read_word_vectors_text(spark, path, 2).collect()}
    assert got == {"cat": [0.5, 0.6], "dog": [0.3, 0.4]}


def test_profile(spark):
    rows = {r["column_name"]: r for r in profile(read_table(spark, SMALL, "documents")).collect()}
    assert rows["text"]["dtype"] == "string" and rows["text"]["non_null"] == rows["text"]["rows"]


def test_streaming_pages(spark):
    base = tempfile.mkdtemp(prefix="corpuslab-stream-")
    src = os.path.join(base, "in")
    read_table(spark, SMALL, "pages").write.parquet(src)
    q = stream_articles(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(base, "out"))
    n_pages = read_table(spark, SMALL, "pages").count()
    assert out.count() == n_pages
    assert out.filter(F.length("body") > 0).count() > 0
