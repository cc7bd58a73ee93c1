"""The versioned store: writes, time travel, index pages, schema, search, logs and streams."""

from __future__ import annotations

import json
import random

import pytest

from annalist.errors import Conflict, NotFound, QueryError, ReadOnly, SchemaError, Unsupported, ValueTypeError
from annalist.sources import logs, store
from annalist.sources.store import Db
from annalist.streaming import follow


@pytest.fixture
def db(spark, tmp_path):
    ticks = iter(range(1767225600000000, 1867225600000000, 1_000_000))
    return Db(spark, f"file://{tmp_path}/store", clock=lambda: next(ticks))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_gauge_over_time(db):
    """Three readings of one gauge, the second one sent twice: views, history, differences and what a view refuses."""
    low, mid, high = 310, 355, 402
    at = [db.transact({"id": "gauge-3", "gauge/level": x})["tx"] for x in (low, mid)]
    again = db.transact({"id": "gauge-3", "gauge/level": mid})
    assert (again["status"], again["tx"], again["asserted"]) == ("noop", None, [])
    at.append(db.transact([{"id": "gauge-3", "gauge/level": high}, {"id": "gauge-8", "gauge/level": low}])["tx"])
    assert at == sorted(at) and db.basis_tx() == at[-1]
    level = {"find": ["?g", "?x"], "where": [["?g", "gauge/level", "?x"]], "order": [["?x", "desc"]]}
    seen = [[tuple(r) for r in view.q(level).collect()] for view in (db.at(at[0]), db.at(at[2]).at(at[1]), db)]
    assert seen == [[("gauge-3", low)], [("gauge-3", mid)], [("gauge-3", high), ("gauge-8", low)]]
    told = db.q({"find": ["?tx", "?x", "?added"], "where": [["gauge-3", "gauge/level", "?x", "?tx", "?added"]], "source": "history"})
    assert sorted((r["x"], r["added"]) for r in told.collect()) == [(low, False), (low, True), (mid, False), (mid, True), (high, True)]
    assert [(r["tx"], r["rx"], r["i"]) for r in db.history("gauge-3", "gauge/level").collect()] == [(at[0], at[1], low), (at[1], at[2], mid), (at[2], None, high)]
    came, went = (sorted(r["i"] for r in side.where("a > 64 AND t = 2").collect()) for side in db.diff(at[0], at[2]))
    assert (came, went) == ([low, mid, high], [low, mid])
    past = db.at(at[1])
    for refused, error in ((lambda: past.transact({"id": "gauge-3", "gauge/level": 1}), ReadOnly), (lambda: past.search(text="x"), Unsupported), (lambda: db.at(at[0] - 60), NotFound), (lambda: db.diff(at[2], at[0]), QueryError)):
        with pytest.raises(error):
            refused()


def test_excision_goes_by_what_events_say(db):
    made = [db.transact({"note/text": f"number {i}", "note/rank": 1000 + i})["event"] for i in range(4)]
    first = int(db.q({"find": ["?e"], "where": [["?e", "note/text", "number 0"]]}).first()["e"])
    db.transact({"id": "list", "list/of": {"ref": first}, "list/size": first})
    linked = db.transact({"id": "other", "list/size": first, "note/text": f"says {first}"})["event"]
    ended = db.transact(["retract", "list", "list/of", {"ref": first}])["event"]
    done = db.excise(first)
    text = {r["event"]: r["data"] for r in db.events().collect()}
    gone = {e for e, data in text.items() if data is None}
    assert gone == set(done["redacts"]) and made[0] in gone and ended in gone
    assert not gone & {*made[1:], linked} and len(gone) == 3
    own = json.loads(text[done["event"]])
    assert own["redacted"] is True and own["redacts"] == sorted(gone)
    assert db.doctor() == [] and not db.q({"find": ["?t"], "where": [[first, "note/text", "?t"]]}).collect()
    with pytest.raises(Conflict):
        db.excise(first)


def test_only_one_of_two_writers_wins(db, spark, monkeypatch):
    db.transact({"id": "a", "x/y": 1})
    slow, quick = Db(spark, db.path), Db(spark, db.path)
    claim = slow._claim

    def late(number, aside):
        quick.transact({"id": "a", "x/y": 2})
        return claim(number, aside)

    monkeypatch.setattr(slow, "_claim", late)
    with pytest.raises(Conflict):
        slow.transact({"id": "a", "x/y": 3})
    folders = [s.getPath().getName() for s in db._fs().listStatus(db._path("versions"))]
    assert not [f for f in folders if f.startswith("_")] and len(folders) == len(set(folders))
    assert [r["y"] for r in Db(spark, db.path).q({"find": ["?y"], "where": [["a", "x/y", "?y"]]}).collect()] == [2]


def test_a_claimed_commit_is_finished_by_the_next_reader(db, spark, monkeypatch):
    db.transact({"id": "a", "x/y": 1})
    monkeypatch.setattr(Db, "_finish", lambda self, number: None)
    db.transact({"id": "a", "x/y": 2})
    monkeypatch.undo()
    later = Db(spark, db.path)
    assert [r["y"] for r in later.q({"find": ["?y"], "where": [["a", "x/y", "?y"]]}).collect()] == [2]
    later.transact({"id": "a", "x/y": 3})
    assert later.doctor() == []


def test_a_store_without_its_mirror(spark, tmp_path, monkeypatch):
    def story(name):
        ticks = iter(range(1767225600000000, 1867225600000000, 1_000_000))
        db = Db(spark, f"file://{tmp_path}/{name}", clock=lambda: next(ticks), event_factory=lambda tx: f"00000000-0000-4000-8000-{tx:012d}")
        db.declare("user/mail", type="text", unique=True)
        db.declare("user/tag", many=True)
        db.transact([{"id": "u1", "user/mail": "a@x", "user/tag": ["p", "q"]}, {"user/mail": "b@x", "user/friend": {"ref": "u1"}}], by="me", operation_id="one")
        db.transact({"user/mail": "b@x", "user/age": 7})
        db.transact(["retract", "u1", "user/tag", "p"])
        assert db.transact({"id": "u1", "user/tag": "q"})["status"] == "noop"
        assert db.transact([{"id": "u1", "user/mail": "a@x", "user/tag": ["p", "q"]}, {"user/mail": "b@x", "user/friend": {"ref": "u1"}}], by="me", operation_id="one")["status"] == "already_applied"
        undone = db.undo(db.basis_tx())
        assert db.entity(["user/mail", "b@x"]) is not None
        return sorted(tuple(str(x) for x in r) for r in db.facts().collect()), undone["status"], [r["hash"] for r in db.events().orderBy("tx").collect()]

    mirrored = story("mirrored")
    monkeypatch.setattr(store, "MIRROR_ROWS", 0)
    assert story("plain") == mirrored


def test_conflicts_operations_and_basis(db):
    with pytest.raises(Conflict):
        db.transact([{"id": "a", "x/y": 1}, {"id": "a", "x/y": 2}])
    one = db.transact({"id": "a", "x/y": 1}, operation_id="op")
    assert db.transact({"id": "a", "x/y": 1}, operation_id="op", if_basis_tx=1)["status"] == "already_applied"
    with pytest.raises(Conflict):
        db.transact({"id": "a", "x/y": 2}, operation_id="op")
    with pytest.raises(Conflict):
        db.transact({"id": "a", "x/y": 2}, if_basis_tx=one["tx"] - 1)
    with pytest.raises(Conflict):
        db.transact(["cas", "a", "x/y", 5, 6])
    db.transact(["cas", "a", "x/y", 1, 2])
    db.transact(["cas", "a", "x/y", 2, {"missing": True}])
    db.transact(["cas", "a", "x/y", {"missing": True}, 9])
    assert json.loads(db.entity_document("a")) == {"x/y": 9}
    for bad in ({"id": "a", "sys/by": "x"}, {"id": "a", "nope": 1}, {"id": "sys/new", "x/y": 1}, {"id": "a", "x/y": [1, 2]}):
        with pytest.raises(SchemaError):
            db.transact(bad)
    for bad in (["retract", "nobody"], ["retract", "a", "x/none"], ["assert", 10**9, "x/y", 1]):
        with pytest.raises(NotFound):
            db.transact(bad)
    with pytest.raises(ValueTypeError):
        db.transact({"id": "a", "x/y": None})


def test_refs_tempids_upsert_and_retract(db):
    db.declare("person/knows", type="ref", many=True)
    db.declare("user/email", type="text", unique=True)
    r = db.transact([{"id": {"tmp": "t"}, "user/email": "a@x", "person/knows": [{"ref": "bob"}, {"user/email": "c@x"}]}])
    assert set(r["ids"]) == {"t"}
    owner = r["ids"]["t"]
    db.transact({"user/email": "a@x", "person/age": 7})
    assert rows(db.q({"find": ["?a"], "where": [[["user/email", "a@x"], "person/age", "?a"]]})) == [(7,)]
    with pytest.raises(Conflict):
        db.transact({"id": "someone", "user/email": "a@x"})
    assert rows(db.q({"find": [["count", "?f"]], "where": [[owner, "person/knows", "?f"]]})) == [(2,)]
    assert {"user/email": "c@x"} in json.loads(db.entity_document(owner, depth=2))["person/knows"]
    db.register_views()
    assert db.spark.sql("SELECT count(*) FROM facts_now WHERE attribute = 'person/age' AND i = 7").first()[0] == 1
    db.transact({"id": "zoe", "person/knows": {"ref": "bob"}})
    assert json.loads(db.pull("bob", ["person/_knows"]))["person/_knows"]
    db.transact(["retract", "bob"])
    assert rows(db.q({"find": ["?e"], "where": [["?e", "person/knows", {"ref": "bob"}]]})) == []
    db.declare("secret/note", nohistory=True)
    db.transact({"id": "n", "secret/note": "one"})
    db.transact({"id": "n", "secret/note": "two"})
    assert rows(db.q({"find": ["?v"], "where": [["n", "secret/note", "?v", "?tx", "?add"]], "source": "history"})) == [("two",)]


def test_mixed_numbers_and_rendered_rows(db):
    db.declare("mixed/value", many=True)
    db.transact({"id": "m", "mixed/value": [1, 1.0, 9007199254740993]})
    q = {"find": [["count", "?v"], ["count-distinct", "?v"]], "where": [["m", "mixed/value", "?v"]]}
    assert rows(db.q(q)) == [(3, 3)]
    assert len(rows(db.q({"find": ["?v"], "where": [["m", "mixed/value", "?v"], ["=", "?v", 1]]}))) == 1
    assert rows(db.q({"find": [["count", "?v"]], "where": [["m", "mixed/value", "?v"], ["=", "?v", 1]]})) == [(2,)]
    assert len(rows(db.q({"find": ["?v"], "where": [["m", "mixed/value", "?v"], [">", "?v", 9007199254740992.0]]}))) == 1
    db.declare("big/value", type="int", many=True)
    db.transact({"id": "b", "big/value": [2**63 - 1, 1]})
    with pytest.raises(Exception, match="64 bits"):
        db.q({"find": [["sum", "?v"]], "where": [["b", "big/value", "?v"]]}).collect()


def test_undo_excise_and_doctor(db):
    one = db.transact({"id": "a", "x/y": 1})
    two = db.transact({"id": "a", "x/y": 2})
    db.undo(two["tx"], by="me")
    assert json.loads(db.entity_document("a")) == {"x/y": 1}
    db.transact({"id": "secret", "x/y": 5, "x/of": {"ref": "a"}})
    done = db.excise("secret")
    assert done["redacts"] and not db.has_id(10**6)
    assert rows(db.q({"find": ["?v"], "where": [["secret", "x/y", "?v"]], "source": "history"})) == []
    assert any('"redacted":true' in line for line in logs.tail(db))
    assert db.doctor() == []
    with pytest.raises(Unsupported):
        db.excise(one["tx"])
    assert db.receipt(two["tx"])["basis_tx"] == one["tx"]
    db.compact()
    assert db.doctor() == [] and json.loads(db.entity_document("a")) == {"x/y": 1}


def test_speculation_keeps_to_itself(db):
    db.transact({"id": "a", "x/y": 1})
    trial = db.speculate()
    trial.transact({"id": "a", "x/y": 2})
    assert json.loads(trial.entity_document("a")) == {"x/y": 2}
    assert json.loads(db.entity_document("a")) == {"x/y": 1}
    with pytest.raises(Unsupported):
        trial.speculate()


def test_concurrent_writers(db, spark):
    db.transact({"id": "a", "x/y": 1})
    other = Db(spark, db.path)
    db.transact({"id": "a", "x/y": 2})
    with pytest.raises(Conflict):
        other.transact({"id": "a", "x/y": 3})
    other.refresh()
    assert other.transact({"id": "a", "x/y": 3})["status"] == "applied"


def test_schema_shapes_and_manifest(db):
    db.declare("item/title", type="text", doc="a title")
    db.declare_shape("shape/item", required=["item/title"], closed=True)
    db.transact({"id": "i", "item/title": "one"})
    db.assign_shape("i", "shape/item")
    assert db.validate("i") == []
    with pytest.raises(SchemaError):
        db.transact(["retract", "i", "item/title"])
    with pytest.raises(SchemaError):
        db.transact({"id": "i", "item/other": 1})
    with pytest.raises(SchemaError):
        db.transact({"id": "i", "item/title": 5})
    with pytest.raises(SchemaError):
        db.declare("item/title", type="int")
    s = db.schema("item/")
    assert s["attributes"][0]["effective"]["type"] == "text" and s["attributes"][0]["observed"]["live_facts"] == 1
    manifest = db.export_schema()
    assert db.check_schema(manifest)["changes"] == [] and manifest["digest"].startswith("sha256:")
    wanted = {"format": "schema/1", "attributes": [{"name": "item/size", "declared": {"type": "int"}}]}
    assert [c["name"] for c in db.check_schema(wanted)["changes"]] == ["item/size", "item/title", "shape/item"]
    with pytest.raises(SchemaError):
        db.apply_schema({"format": "schema/2"})
    assert db.stats()["facts"] >= db.stats()["live_facts"] > 0


def test_pages_and_cursors(db):
    db.transact([{"id": f"e{i}", "k/n": i % 3, "k/f": i / 2} for i in range(7)])
    every = db.datoms("avet", ["k/n"], limit=100)["rows"]
    assert [r["v"] for r in every] == sorted(i % 3 for i in range(7))
    got, cursor = [], None
    while True:
        page = db.datoms("avet", ["k/n"], limit=3, cursor=cursor)
        got += page["rows"]
        cursor = page["cursor"]
        if cursor is None:
            break
    assert got == every
    first = db.datoms("avet", ["k/n"], limit=3)["cursor"]
    for bad in ({"cursor": first, "components": ["k/f"]}, {"cursor": "junk", "components": ["k/n"]}):
        with pytest.raises(QueryError):
            db.datoms("avet", limit=3, **bad)
    db.transact({"id": "e0", "k/n": 5})
    with pytest.raises(QueryError):
        db.datoms("avet", ["k/n"], limit=3, cursor=first)
    assert db.datoms("eavt", ["nobody"])["rows"] == []
    with pytest.raises(QueryError):
        db.datoms("vaet", limit=0)
    assert [x["access"] for x in db.explain({"find": ["?e"], "where": [["?e", "k/n", 1], ["?e", "k/f", "?f"], [">", "?f", 1]]})] == ["avet", "eavt/ea", "barrier"]


def test_search(db):
    db.declare("note/related", type="ref", many=True)
    db.transact([
        {"id": "n1", "note/text": "the quick brown fox", "note/kind": "a", "note/v": {"vector": [1, 0]}, "note/related": [{"ref": "n4"}]},
        {"id": "n2", "note/text": "a quick note", "note/kind": "b", "note/v": {"vector": [0.9, 0.1]}},
        {"id": "n3", "note/text": "nothing here", "note/kind": "a", "note/v": {"vector": [0, 1]}},
        {"id": "n4", "note/text": "elsewhere"},
    ])
    found = db.search(text="quick", vector=[1, 0], vector_attribute="note/v", k=3, expand=1)
    assert [h["entity"] for h in found["hits"]][:2] == ["n2", "n1"] or [h["entity"] for h in found["hits"]][:2] == ["n1", "n2"]
    assert [x["entity"] for x in found["expanded"]] == ["n4"]
    assert {tuple(sorted(m)) for h in found["hits"] for m in h["matched"]} and any("[quick]" in m.get("snippet", "") for h in found["hits"] for m in h["matched"])
    assert len(found["hits"][0]["pull"]) >= 3
    assert [h["entity"] for h in db.search(text="quick", filters=[["note/kind", "b"]])["hits"]] == ["n2"]
    assert db.search(text="...")["hits"] == []
    with pytest.raises(ValueTypeError):
        db.search(vector=[1, 0, 0], vector_attribute="note/v")
    with pytest.raises(ValueTypeError):
        db.search(vector=[0, 0], vector_attribute="note/v")
    with pytest.raises(QueryError):
        db.search()
    with pytest.raises(ValueTypeError):
        db.search(text="x", k=0)


def test_notes_with_a_function_that_embeds(db):
    def embed(text):
        return [float(text.count(c)) + 0.1 for c in "aeiou"]

    db.remember("an apple a day", key="n1", facts={"note/kind": "fruit"}, embed=embed, by="me")
    db.remember("oooh noooo", key="n2", embed=embed)
    db.remember("a banana", key="n1", embed=embed)
    assert [h["entity"] for h in db.recall("papaya", embed=embed, k=2)["hits"]] == ["n1", "n2"]
    assert [h["entity"] for h in db.recall("banana")["hits"]] == ["n1"] and db.recall("apple")["hits"] == []
    rows_ = db.spark.createDataFrame([(1, "aa"), (2, None), (3, "u")], "fact long, text string")
    from annalist.operators.search import embedded

    got = {r.fact: r.v for r in embedded(rows_, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: [1.0, 1.0]}
    s = db.stats()
    assert set(s) == {"application_id", "format_version", "entities", "attributes", "facts", "live_facts", "transactions", "blobs", "size"} and s["size"] > 0


def test_events_snapshot_backup_and_stream(db, spark, tmp_path):
    db.declare("p/knows", type="ref", many=True)
    db.transact([{"id": "a", "p/n": 1.0, "p/knows": [{"ref": "b"}]}, {"id": "b", "p/t": "x" * 300}], by="me", source="s", meta={"k": [1]})
    db.transact(["retract", "a", "p/n"])
    copy = Db(spark, f"file://{tmp_path}/copy")
    lines = [x for x in logs.tail(db, 64)]
    assert all(r["status"] == "applied" for r in logs.apply(copy, lines))
    assert all(r["status"] == "already_applied" for r in logs.apply(copy, lines))
    assert copy.entity_document("a") == db.entity_document("a") and copy.entity_document("b") == db.entity_document("b")
    with pytest.raises(ValueTypeError):
        logs.apply(copy, ["{}"])
    whole = list(logs.snapshot(db))
    again = logs.restore(spark, f"file://{tmp_path}/again", whole)
    assert again.entity_document("a") == db.entity_document("a") and again.basis_tx() == db.basis_tx()
    assert list(logs.snapshot(again)) == whole
    with pytest.raises(Exception, match="not whole"):
        logs.restore(spark, f"file://{tmp_path}/broken", [*whole[:2], *whole[3:]])
    assert logs.backup(db, f"file://{tmp_path}/backup").doctor() == []
    replica = Db(spark, f"file://{tmp_path}/replica")
    for _ in range(2):
        follow.replicate(db, replica, f"file://{tmp_path}/progress").awaitTermination()
        assert replica.entity_document("b") == db.entity_document("b")
        db.transact({"id": "b", "p/m": 3})
    reports = logs.ingest(db, [json.dumps({"id": f"i{k}", "p/n": k}) for k in range(5)], batch_size=2, operation_id="load")
    assert len(reports) == 3 and [r["status"] for r in logs.ingest(db, [json.dumps({"id": f"i{k}", "p/n": k}) for k in range(5)], batch_size=2, operation_id="load")] == ["already_applied"] * 3


def test_random_writes_against_a_dictionary(db):
    rng = random.Random(20)
    state: dict[str, int] = {}
    past = []
    for _ in range(8):
        e = rng.choice(["alpha", "beta", "gamma"])
        if rng.random() < 0.25 and e in state:
            r = db.transact(["retract", e, "state/value"])
            state.pop(e)
        else:
            v = rng.randint(-3, 3)
            r = db.transact({"id": e, "state/value": v})
            state[e] = v
        if r["tx"]:
            past.append((r["tx"], dict(state)))
    q = {"find": ["?e", "?v"], "where": [["?e", "state/value", "?v"]]}
    assert dict(rows(db.q(q))) == state
    for tx, old in past[::3]:
        assert dict(rows(db.at(tx).q(q))) == old
