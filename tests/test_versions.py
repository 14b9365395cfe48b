"""The version store through a sequence of transitions."""

from loomwright.operators import version_store as vs

ACTIONS = "place long, entity_id string, action string, version_number long, data string"


def test_transitions(spark, tmp_path):
    store = vs.VersionStore(spark, str(tmp_path / "store"), buckets=4)
    act = lambda *rows: sorted((r.entity_id or "", r.action or "", r.reason) for r in store.append(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ACTIONS)).collect())
    state = lambda rows: {(r.entity_id, r.version_number): (r.status, r.data, r.rolled_back_from) for r in rows.collect()}
    assert act(("a", "create", None, "one"), ("b", "create", None, "x"), ("a", "create", None, "two"), ("", "create", None, "x"), ("c", "create", None, ""), ("a", "archive", 1, None)) == [
        ("", "create", "entity_id is empty"), ("a", "archive", "no such version"), ("c", "create", "data is empty")]
    assert state(store.states()) == {("a", 1): ("active", "one", None), ("a", 2): ("active", "two", None), ("b", 1): ("active", "x", None)}
    assert act(("a", "deprecate", 1, None), ("a", "archive", 1, None), ("a", "rollback", 9, None), ("b", "rollback", 2, None), ("a", "vanish", 1, None), ("a", None, 1, None)) == [
        ("a", "", "unknown action"), ("a", "rollback", "no such version"), ("a", "vanish", "unknown action"), ("b", "rollback", "no such version")]
    assert state(store.states())["a", 1][0] == "archived"
    assert act(("a", "rollback", 1, None), ("a", "create", None, "four")) == []
    want = {("a", 1): ("rolled_back", "one", None), ("a", 2): ("active", "two", None), ("a", 3): ("active", "one", 1), ("a", 4): ("active", "four", None), ("b", 1): ("active", "x", None)}
    assert state(store.states()) == want == state(store.snapshot())
    stats = {r.entity_id: r for r in vs.version_statistics(store.states()).collect()}
    assert (stats["a"].total, stats["a"].active, stats["a"].rolled_back, stats["a"].bytes, stats["a"].latest) == (4, 3, 1, 13, 4)
    assert act() == []


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = vs.VersionStore(spark, str(tmp_path / "store"), buckets=16)
    store.append(spark.createDataFrame([(i, f"e{i}", "create", None, "x") for i in range(40)], ACTIONS))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "states").rglob("*.parquet")}
    before = files()
    store.append(spark.createDataFrame([(0, "e7", "create", None, "y")], ACTIONS))
    kept = set(before.items()) & set(files().items())
    assert 0 < len(before) - len(kept) <= 2 and store.snapshot().count() == 41
