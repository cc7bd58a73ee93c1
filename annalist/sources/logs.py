"""The portable logs: event/1 for replay, snapshot/1 for exact recovery, and backups."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.errors import Conflict, EngineError, FormatError, TooLarge, Unsupported, ValueTypeError
from annalist.functions import values as V
from annalist.sources.store import LOG, Db, digest
from annalist.sources.transact import SYS

MOST_EVENT_BYTES = 8_454_144


def event_rows(db: Db, since: int = 0, through: int | None = None) -> DataFrame:
    """tx and line of the events after ``since``; a redacted one is a stub of its id and hash."""
    rows = db.events().where((F.col("tx") > since) & (F.col("tx") <= (2**62 if through is None else through)))
    stub = F.concat(F.lit('{"event":"'), "event", F.lit('","hash":"'), "hash", F.lit('","redacted":true}'))
    return rows.select("tx", F.coalesce("data", stub).alias("line"))


def tail(db: Db, since: int = 0) -> Iterator[str]:
    """Event lines in the order of their transactions."""
    for r in event_rows(db, since).orderBy("tx").toLocalIterator():
        yield r["line"]


def write_events(db: Db, path: str, since: int = 0) -> None:
    """The event log as text files, one range of transactions after the other."""
    event_rows(db, since).orderBy("tx").select("line").write.text(path)


def _coerced(tag: str, wire: Any) -> Any:
    return float(wire) if tag == "float" and isinstance(wire, int) else wire


def apply(db: Db, lines: Iterable[str]) -> list[dict]:
    """Replay events that the store does not have yet, all or none.

    Each becomes one transaction with the event's own id; its source time is kept
    as sys/imported-at.  A known id with the same hash is reported as applied; with
    another hash it is a conflict.
    """
    events = []
    for line in lines:
        if not line.strip():
            continue
        if len(line.encode()) > MOST_EVENT_BYTES:
            raise TooLarge("an event line is too long")
        try:
            x = json.loads(line)
            if x["format"] != "event/1" or not isinstance(x["asserted"], list) or not isinstance(x["retracted"], list):
                raise ValueError
        except (ValueError, KeyError, TypeError):
            if '"redacted"' in line:
                raise Unsupported("a redacted event cannot be replayed") from None
            raise ValueTypeError(f"not an event: {line[:80]!r}") from None
        events.append((x, digest(line.rstrip("\n"))))
    trial = db.speculate()
    reports = [_apply_one(trial, x, h) for x, h in events]
    if trial._overlay:
        db._commit(trial._overlay)
    return reports


def _apply_one(db: Db, x: dict, hash_: str) -> dict:
    m = db.mirror()
    old = next((r for r in m.events.values() if r["event"] == x["event"]), None) if m else db.events().where(F.col("event") == x["event"]).first()
    if old:
        imported = db.log().where((F.col("kind") == "imported") & (F.col("event") == x["event"])).first()
        if hash_ not in (old["hash"], imported["hash"] if imported else None):
            raise Conflict("the event is known with another content")
        return db._report("already_applied", x["event"], old["tx"], {}, [], [])

    def change(p) -> None:
        for name in x["created"]:
            if isinstance(name, str) and p.known(name) is None:
                p.create(name)
        for e, a, wire, tag in x["retracted"]:
            attribute = p.known(a)
            owner = p.entity(e if isinstance(e, (str, int)) else {"tmp": e["eid"]}, make=True)
            p.load([owner])
            if attribute is not None:
                p.remove((owner, attribute), p.value(attribute, _coerced(tag, wire)))
        for e, a, wire, tag in x["asserted"]:
            attribute = p.attribute(a, system=True)
            owner = p.entity(e if isinstance(e, str) else {"tmp": str(e if isinstance(e, int) else e["eid"])}, make=True)
            p.add(owner, attribute, *p.value(attribute, _coerced(tag, wire)))

    report = db.transact([], source=x.get("source"), by=x.get("by"), meta=x.get("meta"), tx=x.get("tx_facts"), _event=x["event"], _change=change, _extra=[(SYS["sys/imported-at"], "instant", x["at"])])
    db._commit([{"kind": "imported", "event": x["event"], "hash": hash_}])
    return report


# ---------------------------------------------------------------- snapshots


def snapshot(db: Db) -> Iterator[str]:
    """Header, log rows in a fixed order, and a footer with their number and SHA-256."""
    seal = hashlib.sha256()
    head = V.canonical_json({"format": "snapshot/1", "basis": db.basis_tx()})
    seal.update(head.encode() + b"\n")
    yield head
    n = 0
    facts = db.facts()
    rest = db.log().where("kind NOT IN ('fact', 'end', 'drop')")
    rows = facts.select(F.lit("fact").alias("kind"), *facts.columns)
    for f in LOG.split(", "):
        name, kind = f.split()
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    every = rest.unionByName(rows.select(*rest.columns))
    line = F.to_json(F.struct(*(F.base64(c).alias(c) if c == "b" else F.col(c) for c in every.columns)))
    for r in every.select("kind", "tx", "id", "event", line.alias("line")).orderBy("kind", "tx", "id", "event").toLocalIterator():
        seal.update(r["line"].encode() + b"\n")
        n += 1
        yield r["line"]
    yield V.canonical_json({"end": True, "rows": n, "sha256": seal.hexdigest()})


def restore(spark: SparkSession, path: str, lines: Iterable[str], **options: Any) -> Db:
    """A new store from a snapshot, which is checked in full before anything is written."""
    body = [x.rstrip("\n") for x in lines]
    try:
        head, foot = json.loads(body[0]), json.loads(body[-1])
        if head["format"] != "snapshot/1" or foot["rows"] != len(body) - 2:
            raise ValueError
        if hashlib.sha256("".join(x + "\n" for x in body[:-1]).encode()).hexdigest() != foot["sha256"]:
            raise ValueError
    except (ValueError, KeyError, IndexError, TypeError):
        raise FormatError("the snapshot is not whole") from None
    db = Db.__new__(Db)
    db.spark, db.path, db.basis, db.read_only, db._overlay = spark, path.rstrip("/"), None, False, None  # no genesis
    if db._list():
        raise Conflict("a snapshot is restored to an empty place")
    schema = LOG.replace("b binary", "b string")
    rows = spark.createDataFrame([(x,) for x in body[1:-1]], "line string").select(F.from_json("line", schema).alias("x")).select("x.*")
    db._commit([], base=rows.withColumn("b", F.unbase64("b")))
    out = Db(spark, path, **options)
    if problems := out.doctor():
        raise FormatError(f"the snapshot breaks an invariant: {problems[0]['problem']}")
    return out


def backup(db: Db, path: str) -> Db:
    """A checked copy of a store's present versions in a new place."""
    target = Db.__new__(Db)
    target.spark, target.path, target.basis, target.read_only, target._overlay = db.spark, path.rstrip("/"), None, False, None
    if target._list():
        raise Conflict("a backup does not overwrite")
    target._commit([], base=db.log())
    if problems := target.doctor():
        raise FormatError(problems[0]["problem"])
    return Db(db.spark, path)


# ---------------------------------------------------------------- NDJSON input


def ingest(db: Db, lines: Iterable[str], batch_size: int = 500, operation_id: str | None = None) -> list[dict]:
    """Records, one JSON object per line, in transactions of ``batch_size``; with an operation id each batch can be repeated safely."""
    if not 1 <= batch_size <= 10_000:
        raise ValueTypeError("a batch has 1 to 10000 records")
    reports, batch = [], []

    def send() -> None:
        name = f"{operation_id}:{len(reports)}" if operation_id is not None else None
        reports.append(db.transact(batch, operation_id=name))

    for line in lines:
        if line.strip():
            try:
                batch.append(json.loads(line))
            except ValueError:
                raise ValueTypeError(f"not JSON: {line[:80]!r}") from None
        if len(batch) == batch_size:
            send()
            batch = []
    if batch:
        send()
    return reports


def checked(db: Db) -> Db:
    """The store, if the doctor finds nothing."""
    if problems := db.doctor():
        raise EngineError(str(problems))
    return db
