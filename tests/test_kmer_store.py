"""K-mer stores: pruned reads without exchange, rejection, lists of words as a source."""

import re

import pytest

from kmerloom.operators import kmers
from kmerloom.sources import kmer_store

ROWS = [("a_1", "ACGTACGT"), ("b", "TTTTTT"), ("c", "AC"), ("d", "GATTACA")]


@pytest.fixture
def made(spark, tmp_path):
    seqs = spark.createDataFrame(ROWS, "id string, seq string")
    path = f"file://{tmp_path}/store"
    return path, kmer_store.save(kmers.counts(seqs, [3, 4]), seqs, (3, 4), path, buckets=4)


def words(seq, k):
    return [seq[i : i + k] for i in range(len(seq) - k + 1)]


def rows(df):
    return sorted((r["id"], r["kmer"], r["cnt"], r["k"]) for r in df.collect())


def expected(ids, ks):
    return sorted({(i, w, words(s, k).count(w), k) for i, s in ROWS if i in ids for k in ks for w in words(s, k)})


def test_reads_are_pruned_and_need_no_exchange(spark, made):
    _, store = made
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        per = store.load([3]).join(store.ids.where("k = 3").select("id"), "id").groupBy("id").count()
        plan = per._jdf.queryExecution().toString()
        assert "Exchange" not in plan.split("== Physical Plan ==")[1]
        assert "PartitionFilters: [isnotnull(k" in plan or re.search(r"PartitionFilters: \[.*k#\d+ (IN|=)", plan)
        assert {r["id"]: r["count"] for r in per.collect()} == {i: len(set(words(s, 3))) for i, s in ROWS if len(s) > 2}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stack_rejects_what_does_not_hold_all(spark, made, tmp_path):
    _, store = made
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    found, bad = store.stack([3, 4], ask("b", "c", "d"))
    assert rows(found) == expected("bcd", (3, 4)) and bad == {}  # c has no word but is known
    found, bad = store.stack([3, 4], ask("b", "stranger"))
    assert rows(found) == [] and bad == {3: 1, 4: 1}
    assert store.stack([3], ask("b", "b"))[1] == {3: 1}
    found, bad = store.stack([3, 5], ask("b", "d"))
    assert rows(found) == expected("bd", (3,)) and bad == {5: 2}
    assert store.stack([3], ask())[1] == {} and rows(store.stack([3], ask())[0]) == []
    assert store.stack([4], ask(None))[1] == {4: 1}
    twice = kmer_store.save(store.load([3]), store.ids.where("k = 3").union(store.ids.where("id = 'b'")), (3,), f"file://{tmp_path}/twice", buckets=2)
    assert twice.stack([3], ask("b"))[1] == {3: 1} and twice.stack([3], ask("d"))[1] == {}
    filled = store.filled([4], ask("b", "c", "stranger", "b"))
    assert {(r["id"], r["kmer"], r["cnt"]) for r in filled.collect()} == {("b", "TTTT", 3), ("c", None, 0), ("stranger", None, 0)}


def test_lists_are_parsed_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    (tmp_path / "list.txt").write_text("A_C 3 x,y 1,2\nGGG 1 y 4\nTTT 1 z 9\n\nbroken line\n")
    ids = spark.createDataFrame([("x",), ("y",), ("w",)], "id string")
    assert kmer_store.load(spark, path) is None and not kmer_store.exists(spark, path)
    store = kmer_store.load(spark, path, f"{tmp_path}/list.txt", ids, buckets=2)
    want = [("x", "A_C", 1.0, 3), ("y", "A_C", 2.0, 3), ("y", "GGG", 4.0, 3)]
    assert rows(store.load([3])) == want
    (tmp_path / "list.txt").unlink()
    again = kmer_store.load(spark, path, f"{tmp_path}/list.txt", ids)
    assert rows(again.load([3])) == want
    found, bad = again.stack([3], ids)
    assert bad == {} and {r["kmer"] for r in found.collect()} == {"A.C", "GGG"}
    (tmp_path / "empty.txt").write_text("")
    assert kmer_store.load(spark, f"file://{tmp_path}/none", f"{tmp_path}/empty.txt", ids) is None


def test_a_new_session_opens_a_store(spark, made):
    path, store = made
    for part in ("counts", "ids"):
        spark.sql(f"DROP TABLE {kmer_store._name(path, part)}")
    again = kmer_store.open_store(spark, path)
    assert rows(again.load([3, 4])) == expected({i for i, _ in ROWS}, (3, 4))
    assert "Bucketed: true" in again.load([3]).groupBy("id").count()._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
