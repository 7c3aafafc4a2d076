import json
import random

import pytest
from posts import post
from pyspark.sql import types as T

from chorus.plans.export import write_analysis_document, write_node_link
from chorus.schema import POST_SCHEMA
from chorus.sources import document
from chorus.sources import ingest as I
from chorus.sources.document import read_document

ITEM = T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.StringType()),
                     T.StructField("o", T.StructType([T.StructField("x", T.ArrayType(T.LongType()))]))])
ODD = ['a "quoted" {brace}', "back\\slash\\", "\\\"", "}{][", "é🙂\n\t", "{" * 30, "", "ends with a slash \\"]


def items(n, seed):
    rng = random.Random(seed)
    return [{"i": i, "t": rng.choice(ODD) * rng.randint(0, 4), "o": rng.choice([None, {"x": [i, 1]}, {"x": []}])} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that many tasks share one document."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in names}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(names, (str(size), "1"))]
    for k, v in old.items():
        spark.conf.set(k, v)


def back(df):
    return [json.loads(json.dumps(r.asDict(True))) for r in df.orderBy("_place").drop("_place").collect()]


@pytest.mark.parametrize("size", [37, 500, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_of_a_document_over_many_splits(spark, tmp_path, small_splits, size, indent):
    small_splits(size)
    a, b = items(25, 1), items(7, 2)
    doc = {"meta": {"deep": {"i": -1}, "list": [{"i": -2}], "s": "}{"}, "a": a, "nothing": [], "numbers": [1, [2], "{"], "after": {"i": {"i": -3}}, "b": b}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    got = read_document(spark, str(path), {"a": ITEM, "b": ITEM, "nothing": ITEM, "absent": ITEM})
    assert back(got["a"]) == a and back(got["b"]) == b
    assert back(got["nothing"]) == back(got["absent"]) == []
    path.write_text(json.dumps(a, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert back(read_document(spark, str(path), {"any": ITEM})["any"]) == a


def test_posts_round_trip_through_one_document(spark, tmp_path, make_posts, small_splits):
    posts = make_posts([post(i, ODD[i % len(ODD)], title=None if i % 2 else 'T "{"') for i in range(12)])
    path = f"{tmp_path}/analysis.json"
    write_analysis_document({"by_platform": posts.groupBy("platform").count()}, posts, path, {"queries": ['q"{']})
    whole = json.load(open(path, encoding="utf-8"))
    assert [p["seq"] for p in whole["posts"]] == list(range(12)) and whole["metadata"]["queries"] == ['q"{']
    small_splits(200)
    got = I.read_analysis_posts(spark, path, POST_SCHEMA)
    assert got.rdd.getNumPartitions() > 1
    assert sorted(got.collect(), key=lambda r: r["seq"]) == sorted(posts.collect(), key=lambda r: r["seq"])
    write_analysis_document({}, posts.where("seq < 3"), path)  # replaced
    assert I.read_analysis_posts(spark, path, POST_SCHEMA).count() == 3
    none = T.StructType([f for f in POST_SCHEMA.fields])
    (tmp_path / "bare.json").write_text(json.dumps([{"id": str(i), "platform": "p"} for i in range(9)]))
    seqs = [(r["seq"], r["id"]) for r in I.read_analysis_posts(spark, f"{tmp_path}/bare.json", none).orderBy("seq").collect()]
    assert seqs == [(i, str(i)) for i in range(9)]


def test_a_document_is_written_a_slice_at_a_time(spark, tmp_path, make_posts):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: disk.getAllFiles().mkString(" ").count("shuffle_")
    posts = make_posts([post(i * i, ODD[i % len(ODD)]) for i in range(40)]).repartition(3, "id")
    slices = [[r["line"] for r in s.collect()] for s in document._line_slices(posts, "seq")]
    assert len(slices) == 8 and max(map(len, slices)) < 10
    path, before = tmp_path / "analysis.json", shuffles()
    write_analysis_document({}, posts, str(path))
    assert shuffles() <= before + 3  # of the last job that is not a slice's
    assert [x.name for x in tmp_path.iterdir() if x.suffix != ".crc"] == ["analysis.json"]
    assert [p["seq"] for p in json.loads(path.read_text())["posts"]] == [i * i for i in range(40)]
    assert path.read_text().split("[\n", 1)[1] == "".join(x + "\n" for s in slices for x in s) + "]}\n"


def test_node_link_document_keeps_types(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 3, 0.5), ("b", None, 1.5)], "id string, posts long, score double")
    edges = spark.createDataFrame([("a", "b", 2.0)], "src string, dst string, weight double")
    path = f"{tmp_path}/graph.json"
    write_node_link(nodes, edges, path, document=True)
    n, e = I.read_graph(spark, path, nodes.schema, T.StructType().add("source", "string").add("target", "string").add("weight", "double"))
    assert sorted(n.collect()) == sorted(nodes.collect()) and e.select("src", "dst", "weight").collect() == edges.collect()
    n, e = I.read_graph(spark, path)
    assert {r["id"]: r["attrs"]["score"] for r in n.collect()} == {"a": "0.5", "b": "1.5"}
    assert e.first()["weight"] == 2.0


def test_empty_file(spark, tmp_path):
    (tmp_path / "none.json").write_text("")
    assert read_document(spark, f"{tmp_path}/none.json", {"a": ITEM})["a"].collect() == []
