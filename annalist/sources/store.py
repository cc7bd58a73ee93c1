"""A versioned store of facts in Parquet.

Every commit is a folder of log rows, written aside, claimed and renamed into
place.  The claim is a file named by the version's number that only one writer
can make; it names the folder, so whoever lists the versions next can finish a
rename that its writer did not.  A version is whole or absent.
Readers list the versions once and stay with them.  ``compact`` folds all
versions into one and leaves the old files to readers until the next time;
excision does the same without the rows it removes, and deletes them at once.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.errors import Conflict, EngineError, NotFound, QueryError, ReadOnly, SchemaError, Unsupported, ValueTypeError
from annalist.functions import values as V
from annalist.functions.text import capped, snippet
from annalist.model import FACTS, Scan
from annalist.operators import datoms as index
from annalist.operators import schema as checks
from annalist.operators import search, temporal
from annalist.operators.pull import documents, entity
from annalist.plans import ast
from annalist.plans.query import run
from annalist.sources.keywords import KeywordIndex
from annalist.sources.transact import _FIELDS, FIRST_TX, RESERVED, SYS, SYSTEM, Declared, Fact, Planner, check_attribute, check_name, without_entity

LOG = "kind string, id bigint, e bigint, a bigint, t tinyint, i bigint, d double, s string, b binary, f array<float>, tx bigint, rx bigint, name string, event string, hash string, data string, operation string, request string"
APPLICATION = "annalist"
MIRROR_ROWS = 50_000
_LOG_FIELDS = [x.split()[0] for x in LOG.split(", ")]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Mirror:
    """The log of a small store on the driver, so that the planner's point lookups need no job.

    Stores of more than MIRROR_ROWS log rows are looked up with filters instead.
    """

    def __init__(self) -> None:
        self.names: dict[int, str | None] = {}
        self.ids: dict[str, int] = {}
        self.events: dict[int, dict] = {}
        self.facts: dict[int, Fact] = {}
        self.at: dict[int, int] = {}
        self.rows = self.last_fact = 0

    def add(self, rows: list[dict]) -> None:
        self.rows += len(rows)
        for r in sorted(rows, key=lambda r: r["kind"] in ("end", "drop")):
            if r["kind"] == "id":
                self.names[r["id"]] = r.get("name")
                if r.get("name") is not None:
                    self.ids[r["name"]] = r["id"]
            elif r["kind"] == "event":
                self.events[r["tx"]] = r
            elif r["kind"] == "fact":
                self.last_fact = max(self.last_fact, r["id"])
                f = Db._fact({**dict.fromkeys(_LOG_FIELDS), **r})
                if r.get("rx") is None:
                    self.facts[f.id] = f
                if f.a == SYS["sys/at"] and f.e == f.tx:
                    self.at[f.tx] = f.value
            elif r["kind"] in ("end", "drop"):
                self.facts.pop(r["id"], None)


class Db:
    """A store, or a read-only view of one at a basis."""

    def __init__(self, spark: SparkSession, path: str, clock=None, event_factory=None, basis: int | None = None, read_only: bool = False) -> None:
        self.spark, self.path, self.basis = spark, path.rstrip("/"), basis
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self.event_factory = event_factory or (lambda tx: str(uuid.uuid4()))
        self.read_only = read_only or basis is not None
        self._overlay: list[dict] | None = None
        self._versions: list[str] | None = None
        self._memo: dict[tuple, Any] = {}  # answers about the present version
        if not self._list():
            if self.read_only:
                raise NotFound(f"no store at {path}")
            self._genesis()

    # ------------------------------------------------------------ versions

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _list(self) -> list[str]:
        fs, at = self._fs(), self._path("versions")
        self._memo, self._mirror = {}, None
        found = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        found = [v for v in found if v[0] in "0123456789"]
        if fs.exists(self._path("claims")):
            last = found[-1][:12] if found else ""
            for name in sorted(c.getPath().getName() for c in fs.listStatus(self._path("claims"))):
                if name.isdigit() and name > last and (made := self._finish(name)):
                    found.append(made)
        bases = [v for v in found if v.endswith("-base")]
        self._versions = [v for v in found if not bases or v >= bases[-1]]
        return self._versions

    def _claim(self, number: str, aside: str) -> bool:
        """Make the claim of a version, which names its folder; False if there is one."""
        fs, mine, to = self._fs(), self._path("claims", f"_{aside}"), self._path("claims", number)
        fs.mkdirs(self._path("claims"))
        out = fs.create(mine, True)
        out.write(bytearray(aside.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename would overwrite here; a hard link does not
                jvm = self.spark._jvm
                link = [jvm.java.nio.file.Path.of(jvm.java.net.URI.create("file://" + fs.makeQualified(p).toUri().getRawPath())) for p in (to, mine)]
                try:
                    jvm.java.nio.file.Files.createLink(*link)
                except Py4JJavaError:
                    return False
                return True
            return bool(fs.rename(mine, to))
        finally:
            fs.delete(mine, False)

    def _finish(self, number: str) -> str | None:
        """Rename a claimed version into place, if that is still to be done; its name."""
        fs = self._fs()
        stream = fs.open(self._path("claims", number))
        try:
            aside = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        name = number + ("-base" if aside.endswith("-base") else "")
        if not fs.exists(self._path("versions", name)):
            fs.rename(self._path("versions", aside), self._path("versions", name))
        return name if fs.exists(self._path("versions", name)) else None

    def _commit(self, rows: list[dict], base: DataFrame | None = None) -> None:
        if self._overlay is not None:
            mirror = self.mirror()
            self._overlay += rows
            self._memo = {}
            if mirror is not None:
                mirror.add(rows)
            return
        number = f"{int((self._versions or ['-1'])[-1][:12]) + 1:012d}"
        aside = f"_aside-{uuid.uuid4().hex}{'-base' if base is not None else ''}"
        df = base if base is not None else self.spark.createDataFrame([tuple(r.get(f) for f in _LOG_FIELDS) for r in rows], LOG).coalesce(1)
        df.write.parquet(f"{self.path}/versions/{aside}")
        fs = self._fs()
        taken = any(fs.exists(self._path("versions", number + end)) for end in ("", "-base"))
        if taken or not self._claim(number, aside):
            fs.delete(self._path("versions", aside), True)
            raise Conflict("another writer was first")
        self._finish(number)
        mirror = self._mirror if base is None else None
        self._list()
        if mirror and mirror.rows <= MIRROR_ROWS:
            mirror.add(rows)
            self._mirror = mirror

    def log(self) -> DataFrame:
        return self._once(("log",), self._log)

    def _log(self) -> DataFrame:
        out = self.spark.read.schema(LOG).parquet(*(f"{self.path}/versions/{v}" for v in self._versions or []))
        return out.unionByName(self.spark.createDataFrame([tuple(r.get(f) for f in _LOG_FIELDS) for r in self._overlay], LOG)) if self._overlay else out

    def refresh(self) -> None:
        self._list()

    def _genesis(self) -> None:
        at = self.clock()
        rows = [{"kind": "id", "id": i, "name": n, "tx": FIRST_TX} for n, i in SYS.items()] + [{"kind": "id", "id": FIRST_TX, "tx": FIRST_TX}]
        rows.append({"kind": "fact", "id": 1, "e": FIRST_TX, "a": SYS["sys/at"], "t": V.INSTANT, "i": at, "tx": FIRST_TX})
        body = V.canonical_json({"format": "event/1", "event": str(uuid.UUID(int=64)), "at": at, "created": [], "asserted": [], "retracted": []})
        rows.append({"kind": "event", "tx": FIRST_TX, "event": str(uuid.UUID(int=64)), "hash": digest(body), "data": body})
        self._commit(rows)

    # ------------------------------------------------------------ tables

    def facts(self) -> DataFrame:
        """All retained facts in the physical layout."""
        return self._once(("facts",), self._facts)

    def _facts(self) -> DataFrame:
        log = self.log()
        gone = log.where("kind = 'drop'").select("id")
        ends = log.where("kind = 'end'").groupBy("id").agg(F.max("rx").alias("end"))
        own = log.where("kind = 'fact'").join(gone, "id", "left_anti").join(ends, "id", "left").withColumn("rx", F.coalesce("rx", "end"))
        out = own.select(*(f.split()[0] for f in FACTS.split(", ")))
        return out if self.basis is None else out.where(F.col("tx") <= self.basis).withColumn("rx", temporal.hidden_rx(self.basis))

    def live(self) -> DataFrame:
        return self._once(("live",), self._live)

    def _live(self) -> DataFrame:
        return temporal.visible(self.facts(), self.basis)

    def ids(self) -> DataFrame:
        return self._once(("ids",), self._ids)

    def _ids(self) -> DataFrame:
        out = self.log().where("kind = 'id'").select("id", "name", F.col("tx").alias("created_tx"))
        return out if self.basis is None else out.where(F.col("created_tx") <= self.basis)

    def events(self) -> DataFrame:
        return self._once(("events",), self._events)

    def _events(self) -> DataFrame:
        log = self.log()
        redacted = log.where("kind = 'redact'").select("event").distinct().withColumn("gone", F.lit(True))
        out = log.where("kind = 'event'").select("tx", "event", "hash", "data", "operation", "request").join(redacted, "event", "left")
        out = out.withColumn("data", F.when(F.col("gone").isNull(), F.col("data"))).drop("gone")
        return out if self.basis is None else out.where(F.col("tx") <= self.basis)

    def transactions(self) -> DataFrame:
        """tx, at, by and source of every transaction."""
        return self._once(("transactions",), self._transactions)

    def _transactions(self) -> DataFrame:
        f = self.facts()

        def of(name: str, column: str, out: str) -> DataFrame:
            return f.where((F.col("a") == SYS[name]) & (F.col("e") == F.col("tx"))).select("tx", F.col(column).alias(out))

        return of("sys/at", "i", "at").join(of("sys/by", "s", "by"), "tx", "left").join(of("sys/source", "s", "source"), "tx", "left")

    def _once(self, key: tuple, find) -> Any:
        if key not in self._memo:
            if len(self._memo) > 10_000:
                self._memo.clear()
            self._memo[key] = find()
        return self._memo[key]

    def basis_tx(self) -> int:
        if m := self.mirror():
            return max(m.events)
        return self.basis if self.basis is not None else self._once(("basis",), lambda: self.events().agg(F.max("tx").alias("m")).first()["m"])

    # ------------------------------------------------------------ lookups for the planner

    def mirror(self) -> Mirror | None:
        """The driver's copy of a small store's present; None for views and large stores."""
        if self.basis is not None:
            return None
        if self._mirror is None:
            found = self.log().limit(MIRROR_ROWS + 1).collect()
            if len(found) > MIRROR_ROWS:
                self._mirror = False
            else:
                self._mirror = Mirror()
                self._mirror.add([r.asDict() for r in found])
        return self._mirror or None

    def next_id(self) -> int:
        if m := self.mirror():
            return max(max(m.names), FIRST_TX) + 1
        return self._once(("next",), lambda: max(self.ids().agg(F.max("id").alias("m")).first()["m"], FIRST_TX) + 1)

    def id_of(self, name: str) -> int | None:
        if m := self.mirror():
            return m.ids.get(name)
        r = self._once(("id", name), lambda: self.ids().where(F.col("name") == name).select("id").first())
        return r["id"] if r else SYS.get(name)

    def has_id(self, e: int) -> bool:
        if m := self.mirror():
            return e in m.names
        return self._once(("has", e), lambda: not self.ids().where(F.col("id") == e).isEmpty())

    def is_transaction(self, e: int) -> bool:
        if m := self.mirror():
            return e in m.events
        return self._once(("tx", e), lambda: not self.events().where(F.col("tx") == e).isEmpty())

    @staticmethod
    def _fact(r) -> Fact:
        kind = V.KIND_OF_TAG[r["t"]]
        x = r[V.FIELD[kind]]
        return Fact(r["id"], r["e"], r["a"], kind, bool(x) if kind == "bool" else bytes(x) if kind == "bytes" else x, r["tx"])

    def live_of(self, entities: list[int]) -> list[Fact]:
        if m := self.mirror():
            return [replace(f) for f in m.facts.values() if f.e in set(entities)]
        return [self._fact(r) for r in self.live().where(F.col("e").isin(entities)).orderBy("id").collect()]

    def live_with(self, a: int) -> list[Fact]:
        if m := self.mirror():
            return [replace(f) for f in m.facts.values() if f.a == a]
        return [self._fact(r) for r in self.live().where(F.col("a") == a).collect()]

    def inbound(self, e: int) -> list[Fact]:
        if m := self.mirror():
            return [replace(f) for f in m.facts.values() if f.kind == "ref" and f.value == e]
        return [self._fact(r) for r in self.live().where((F.col("t") == V.REF) & (F.col("i") == e)).orderBy("id").collect()]

    def owners(self, a: int, kind: str, value: Any) -> list[int]:
        if m := self.mirror():
            key = Fact(None, 0, a, kind, value).key
            return sorted({f.e for f in m.facts.values() if f.a == a and f.key == key})
        column = F.col(V.FIELD[kind])
        rows = self.live().where((F.col("a") == a) & (F.col("t") == V.tag_of(kind, value)) & (column == V.literal(kind, value).cast("bigint" if kind == "bool" else V.SPARK_TYPE[kind])))
        return [r["e"] for r in rows.select("e").distinct().collect()]

    # ------------------------------------------------------------ the source protocol

    def _attribute(self, name: Any) -> int | None:
        a = name if isinstance(name, int) else self.id_of(name) if isinstance(name, str) else None
        return a

    def _rows(self, history: bool) -> DataFrame:
        return temporal.datoms(self.facts(), self.basis) if history else self.live().withColumn("added", F.lit(True))

    def scan(self, attribute: Any, history: bool = False, entity: int | None = None, target: int | None = None) -> Scan | None:
        a = self._attribute(attribute)
        if a is None:
            return None
        rows = self._rows(history).where(F.col("a") == a)
        if entity is not None:
            rows = rows.where(F.col("e") == entity)
        tags = self._once(("tags", a, history, entity), lambda: [r["t"] for r in rows.select("t").distinct().collect()])
        kinds = {V.KIND_OF_TAG[t] for t in tags}
        if not kinds:
            return None
        kind = kinds.pop() if len(kinds) == 1 else "any"
        return Scan(rows.select("e", V.from_fields(kind, {c: F.col(c) for c in ("t", "i", "d", "s", "b", "f")}).alias("v"), "tx", "added"), kind, not history)

    def scan_all(self, history: bool = False) -> Scan:
        rows = self._rows(history)
        return Scan(rows.select("e", "a", V.from_fields("any", {c: F.col(c) for c in ("t", "i", "d", "s", "b", "f")}).alias("v"), "tx", "added"), "any", not history)

    def entity(self, constant: Any) -> int | None:
        if isinstance(constant, int) and not isinstance(constant, bool):
            return constant
        if isinstance(constant, str):
            return self.id_of(constant)
        if isinstance(constant, list) and len(constant) == 2:
            a = self.id_of(check_attribute(constant[0]))
            found = self.owners(a, *V.encode(constant[1])) if a is not None else []
            return found[0] if len(found) == 1 else None
        raise QueryError(f"not an entity: {constant!r}")

    def named(self, df: DataFrame, column: str, out: str) -> DataFrame:
        names = self.ids().where("name IS NOT NULL").select(F.col("id").alias("__id"), F.col("name").alias(out))
        return df.join(names, df[column] == names["__id"], "left").drop("__id")

    def many(self, attribute: str) -> bool:
        a = self.id_of(attribute)
        return bool(a and Planner(self).declared(a).many)

    # ------------------------------------------------------------ writes

    def transact(self, data: Any, source: str | None = None, by: str | None = None, meta: Any = None, tx: dict | None = None, operation_id: str | None = None, if_basis_tx: int | None = None, _request: Any = None, _extra: list | None = None, _event: str | None = None, _change: Any = None, _body: dict | None = None) -> dict:
        """Apply records and operations as one transaction, and report it."""
        self._writable()
        options = {k: v for k, v in (("by", by), ("meta", meta), ("source", source), ("tx", tx)) if v is not None}
        request = digest(V.canonical_json(_request if _request is not None else {"data": data, "options": options}))
        if operation_id is not None:
            check_name(operation_id)
            m = self.mirror()
            old = next((r for r in m.events.values() if r.get("operation") == operation_id), None) if m else self.events().where(F.col("operation") == operation_id).first()
            if old:
                if old["request"] != request:
                    raise Conflict("the operation id was used for another request")
                return self._report("already_applied", old["event"], old["tx"], {}, [], [])
        now = self.basis_tx()
        if if_basis_tx is not None and if_basis_tx != now:
            raise Conflict(f"the basis is {now}, not {if_basis_tx}")
        planner = Planner(self)
        if tx:
            for k in tx:
                check_attribute(k)
            tx_attributes = {k: planner.attribute(k) for k in sorted(tx)}
        if _change is not None:
            _change(planner)
            plan = planner.finish()
        else:
            plan = planner.run(data)
        extra = [(SYS[n], kind, x) for n, kind, x in (("sys/by", "text", by), ("sys/source", "text", source)) if x is not None]
        if meta is not None:
            extra.append((SYS["sys/meta"], "json", V.canonical_json(meta, V.MAX_DEPTH)))
        extra += _extra or []
        if tx:
            for k, a in tx_attributes.items():
                for w in tx[k] if isinstance(tx[k], list) else [tx[k]]:
                    extra.append((a, *planner.value(a, w)))
            plan.created |= {a: k for k, a in tx_attributes.items() if a >= planner.db.next_id()}
        if not (plan.asserted or plan.retracted or plan.created or extra or operation_id):
            return {"status": "noop", "event": None, "basis_tx": now, "tx": None, "at": None, "ids": {}, "asserted": [], "retracted": []}
        moved = {e: i for i, e in enumerate(sorted(plan.created), self.next_id())}  # ids without gaps, the transaction's last
        new_tx = self.next_id() + len(moved)
        m = self.mirror()
        last = max(m.at.values(), default=None) if m else self.transactions().agg(F.max("at").alias("m")).first()["m"]
        at = self.clock()
        at = at if last is None or at > last else last + 1_000_000
        fact_id = (m.last_fact if m else self.log().where("kind = 'fact'").agg(F.max("id").alias("m")).first()["m"] or 0) + 1
        rows = [{"kind": "id", "id": moved[e], "name": n, "tx": new_tx} for e, n in plan.created.items()] + [{"kind": "id", "id": new_tx, "tx": new_tx}]
        for f in plan.asserted:
            f.e, f.a = moved.get(f.e, f.e), moved.get(f.a, f.a)
            if f.kind == "ref":
                f.value = moved.get(f.value, f.value)
        facts = plan.asserted + [Fact(None, new_tx, moved.get(a, a), k, moved.get(x, x) if k == "ref" else x) for a, k, x in [(SYS["sys/at"], "instant", at), *extra]]
        for f in facts:
            f.id, f.tx = fact_id, new_tx
            fact_id += 1
            rows.append(self._fact_row(f))
        for f in plan.retracted:
            rows.append({"kind": "drop", "id": f.id} if planner.declared(f.a).forgets else {"kind": "end", "id": f.id, "rx": new_tx})
        names = {moved.get(e, e): n for e, n in plan.created.items()}
        event = _event or self.event_factory(new_tx)
        body = {"format": "event/1", "event": event, "at": at, "created": [n if n is not None else {"eid": str(uuid.uuid5(uuid.UUID(event), str(i)))} for i, (_, n) in enumerate(sorted(names.items()))],
                "asserted": [self._tuple(f, names) for f in plan.asserted], "retracted": [self._tuple(f, names) for f in plan.retracted], **{k: v for k, v in options.items() if k != "tx"}}
        if tx:
            body["tx_facts"] = tx
        body |= _body or {}
        text = V.canonical_json(body)
        # What the event is about, as rows, so that an excision can find it by what it says and not by how that is written.
        about = {x for f in [*facts, *plan.retracted] for x in (f.e, f.a, f.value if f.kind == "ref" else f.e)} | set(names)
        rows += [{"kind": "mention", "e": e, "tx": new_tx, "event": event} for e in sorted(about - {new_tx}) if e > RESERVED]
        rows.append({"kind": "event", "tx": new_tx, "event": event, "hash": digest(text), "data": text, "operation": operation_id, "request": request if operation_id is not None else None})
        self._commit(rows)
        return self._report("applied", event, new_tx, {t: self._shown(moved.get(e, e)) for t, e in plan.tempids.items()}, plan.asserted, plan.retracted, at)

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnly("a view is not written to")

    @staticmethod
    def _fact_row(f: Fact) -> dict:
        field = V.FIELD[f.kind]
        return {"kind": "fact", "id": f.id, "e": f.e, "a": f.a, "t": V.tag_of(f.kind, f.value), field: int(f.value) if field == "i" else bytearray(f.value) if field == "b" else f.value, "tx": f.tx}

    def _shown(self, e: int, names: dict[int, str | None] | None = None) -> Any:
        if names and names.get(e):
            return names[e]
        if m := self.mirror():
            return e if m.names.get(e) is None else m.names[e]
        r = self._once(("name", e), lambda: self.ids().where(F.col("id") == e).first())
        return r["name"] if r and r["name"] is not None else SYSTEM[e - 1] if e <= len(SYSTEM) else e

    def _tuple(self, f: Fact, names: dict[int, str | None] | None = None) -> list:
        return [self._shown(f.e, names), self._shown(f.a, names), V.render(f.kind, f.value, self._shown(f.value, names) if f.kind == "ref" else None), f.kind]

    def _rendered(self, f: Fact) -> dict:
        return {"id": f.id, "e": self._shown(f.e), "a": self._shown(f.a), "v": V.render(f.kind, f.value, self._shown(f.value) if f.kind == "ref" else None), "tx": f.tx}

    def _report(self, status: str, event: str, tx: int, ids: dict, asserted: list[Fact], retracted: list[Fact], at: int | None = None) -> dict:
        if m := self.mirror():
            prior, at = max((t for t in m.events if t < tx), default=None), m.at.get(tx, at)
        else:
            prior = self.events().where(F.col("tx") < tx).agg(F.max("tx").alias("m")).first()["m"]
        if at is None:
            r = self.transactions().where(F.col("tx") == tx).first()
            at = r["at"] if r else None
        return {"status": status, "event": event, "basis_tx": prior, "tx": tx, "at": at, "ids": ids, "asserted": [self._rendered(f) for f in asserted], "retracted": [self._rendered(f) for f in retracted]}

    def remember(self, text: str, key: str | None = None, facts: dict | None = None, embed: Callable[[str], list[float]] | None = None, **options: Any) -> dict:
        """Keep a note with its vector, if a function that embeds texts is given; a note with a key replaces the one before."""
        record = {"id": key if key is not None else {"tmp": "note"}, **(facts or {}), "memory/text": text}
        if embed is not None:
            record["memory/embedding"] = {"vector": [float(x) for x in embed(text)]}
        return self.transact(record, **options)

    def recall(self, text: str, k: int = 10, embed: Callable[[str], list[float]] | None = None, **options: Any) -> dict:
        """Search notes by keywords and, with the function that embedded them, by meaning."""
        vector = [float(x) for x in embed(text)] if embed is not None else None
        return self.search(text=text, vector=vector, vector_attribute="memory/embedding" if vector is not None else None, k=k, text_attributes=["memory/text"], **options)

    def declare(self, attribute: str, **declared: Any) -> dict:
        """Set declarations of an attribute (type, many, unique, nohistory, dims, doc, vector_model)."""
        check_attribute(attribute)
        if declared.pop("ref", False):
            declared["type"] = "ref"
        if extra := set(declared) - set(_FIELDS):
            raise SchemaError(f"no declarations {sorted(extra)}")
        return self._system_write([(attribute, _FIELDS[k], v) for k, v in declared.items() if v is not None])

    def _system_write(self, wanted: list[tuple[Any, str, Any]], retract: list[tuple[Any, str, Any]] = (), **options: Any) -> dict:
        def change(p: Planner) -> None:
            for name, s, v in retract:
                e = p.entity(name)
                p.load([e])
                p.remove((e, SYS[s]), None if v is None else p.value(SYS[s], v))
            for name, s, v in wanted:
                e = p.attribute(name) if s in _FIELDS.values() else p.entity(name, make=True)
                if s in ("sys/required", "sys/allowed"):
                    p.add(e, SYS[s], "ref", p.attribute(v))
                    continue
                kind, x = V.encode(v)
                want = {"sys/many": "bool", "sys/unique": "bool", "sys/nohistory": "bool", "sys/closed": "bool", "sys/dims": "int"}.get(s, "text")
                if kind != want:
                    raise SchemaError(f"{s} is {want}")
                p.add(e, SYS[s], kind, x)

        return self.transact([], _change=change, **options)

    def declare_shape(self, name: str, required: list[str] = (), allowed: list[str] = (), closed: bool = False) -> dict:
        """Name a set of required and allowed attributes; a closed shape allows no others."""
        check_name(name)
        may = sorted({*allowed, *(required if closed else ())})
        return self._system_write([*((name, "sys/required", a) for a in sorted(set(required))), *((name, "sys/allowed", a) for a in may), (name, "sys/closed", bool(closed))])

    def assign_shape(self, ref: Any, shape: str) -> dict:
        return self.transact([], _change=lambda p: p.add(p.entity(ref, make=True), SYS["sys/shape"], "ref", p.entity(shape)))

    def undo(self, tx: int, by: str | None = None, operation_id: str | None = None) -> dict:
        """Take back what still holds of a transaction, in a new one that names it."""
        self._writable()
        if tx == FIRST_TX or not self.is_transaction(tx):
            raise NotFound(f"no transaction {tx}")
        target = self.spark.createDataFrame([(tx,)], "target long")
        from annalist.sources.transact import undo_rows

        own = self.facts().where(F.col("e") != F.col("tx"))
        steps = [(r["op"], self._fact(r)) for r in undo_rows(own, target).orderBy("id").collect()]

        def change(p: Planner) -> None:
            for op, f in sorted(steps, key=lambda s: s[0] != "retract"):
                p.load([f.e])
                if op == "retract":
                    p.remove((f.e, f.a), f.key)
                else:
                    p.add(f.e, f.a, f.kind, f.value)

        request = {"operation": "undo", "tx": tx} | ({"by": by} if by is not None else {})
        return self.transact([], by=by, operation_id=operation_id, _request=request, _extra=[(SYS["sys/undoes"], "ref", tx)], _change=change)

    def excise(self, ref: Any, operation_id: str | None = None, if_basis_tx: int | None = None) -> dict:
        """Physically remove every fact that mentions an entity, and every event that does."""
        self._writable()
        e = Planner(self).entity(ref)
        if e <= RESERVED or self.is_transaction(e):
            raise Unsupported("system and transaction entities stay")
        facts, log = self.facts(), self.log()
        gone = facts.join(without_entity(facts, e).select("id"), "id", "left_anti")
        told = log.where((F.col("kind") == "mention") & (F.col("e") == e)).select("tx").unionByName(gone.select("tx")).unionByName(gone.where("rx IS NOT NULL").select(F.col("rx").alias("tx")))
        touched = sorted(r["event"] for r in self.events().where("data IS NOT NULL").join(told.distinct(), "tx", "left_semi").select("event").collect())
        already = log.where("kind = 'event' AND operation IS NOT NULL").where(F.col("operation") == operation_id).isEmpty() if operation_id is not None else True
        if already and not self.live().where((F.col("a") == SYS["sys/excised"]) & (F.col("i") == e)).isEmpty():
            raise Conflict("the entity was excised before")
        report = self.transact([], operation_id=operation_id, if_basis_tx=if_basis_tx, _request={"operation": "excise", "ref": ref}, _extra=[(SYS["sys/excised"], "ref", e)], _body={"redacted": True, "redacts": touched})
        if report["status"] != "applied":
            return report
        marker = (F.col("a") == SYS["sys/excised"]) & (F.col("e") == F.col("tx"))
        log = self.log()
        doomed = self.facts().select("id").join(without_entity(self.facts().where(~marker), e).unionByName(self.facts().where(marker)).select("id"), "id", "left_anti")
        rest = log.where("kind NOT IN ('fact', 'end', 'drop')").unionByName(log.where("kind IN ('fact', 'end', 'drop')").join(doomed, "id", "left_anti").select(*log.columns))
        redacts = self.spark.createDataFrame([(x,) for x in touched], "event string").withColumn("__gone", F.lit(True))
        rest = rest.where(~((F.col("kind") == "mention") & (F.col("e") == e))).join(redacts, "event", "left")
        rest = rest.withColumn("data", F.when(F.col("__gone").isNull(), F.col("data"))).select(*log.columns)
        self._rebase(rest, at_once=True)
        return report | {"redacts": touched}

    def compact(self) -> None:
        """Fold all versions into one; earlier versions are deleted."""
        self._writable()
        facts = self.facts()
        rest = self.log().where("kind NOT IN ('fact', 'end', 'drop')")
        rows = facts.select(F.lit("fact").alias("kind"), *facts.columns)
        for f in LOG.split(", "):
            n, t = f.split()
            if n not in rows.columns:
                rows = rows.withColumn(n, F.lit(None).cast(t))
        self._rebase(rest.unionByName(rows.select(*rest.columns)))

    def _rebase(self, rows: DataFrame, at_once: bool = False) -> None:
        """Replace all versions; readers of the present ones keep them until the next time, unless they must go ``at_once``."""
        kept = set() if at_once else set(self._versions or [])
        self._commit([], base=rows)
        for v in [s.getPath().getName() for s in self._fs().listStatus(self._path("versions"))]:
            if v[0] in "0123456789" and v not in kept and v not in self._versions:
                self._fs().delete(self._path("versions", v), True)
        self._list()

    def speculate(self) -> Db:
        """A writable copy that keeps its writes to itself."""
        if self._overlay is not None or self.basis is not None:
            raise Unsupported("a speculation starts from a store")
        out = Db(self.spark, self.path, self.clock, self.event_factory)
        out._overlay = []
        return out

    # ------------------------------------------------------------ reads

    def at(self, when: Any) -> Db:
        """A read-only view as of a transaction or an instant."""
        when = V.parse_instant(when) if isinstance(when, str) else when
        if isinstance(when, bool) or not isinstance(when, int):
            raise ValueTypeError("a basis is a transaction or an instant")
        tx = temporal.basis_at(self.transactions(), when)
        return Db(self.spark, self.path, basis=tx if self.basis is None else min(tx, self.basis))

    def q(self, query: dict, args: dict | None = None) -> DataFrame:
        return run(self, query, args)

    def explain(self, query: dict) -> list[dict]:
        """The access class of each pattern, and the barriers between them; nothing is evaluated."""
        q = ast.parse(query)
        out, bound = [], set(q.inputs)
        for c in q.where:
            if not isinstance(c, ast.Pattern):
                out.append({"clause": type(c).__name__.lower(), "access": "barrier"})
            else:
                e, a, v = (t != "_" and (not ast.is_variable(t) or t in bound) for t in c.terms[:3])
                access = "eavt/exact" if e and a and v else "eavt/ea" if e and a else "avet" if a and v else "eavt/e" if e else "avet/a" if a else "value-scan" if v else "scan"
                out.append({"clause": "pattern", "access": access})
            bound |= set(c.variables()) if not isinstance(c, ast.Not) else set()
        return out

    def _known(self, ref: Any) -> int:
        e = self.entity(ref["ref"] if isinstance(ref, dict) else ref)
        if e is None or not self.has_id(e):
            raise NotFound(f"no entity {ref!r}")
        return e

    def pull(self, ref: Any, pattern: list) -> str:
        """One entity's document as canonical JSON."""
        return documents(self, self.spark.createDataFrame([(self._known(ref),)], "e long"), pattern).first()["doc"]

    def entity_document(self, ref: Any, depth: int = 1) -> str:
        """Everything an entity has, as canonical JSON; references are followed ``depth`` - 1 times."""
        if isinstance(depth, bool) or not 1 <= depth <= 16:
            raise QueryError("depth is 1 to 16")
        return entity(self, self._known(ref), depth).first()["doc"]

    def many_names(self) -> list[str]:
        """Names of the attributes that are declared to have many values."""
        own = self.live().where((F.col("a") == SYS["sys/many"]) & (F.col("i") == 1)).select(F.col("e").alias("id"))
        return [r["name"] for r in self.ids().join(own, "id").select("name").collect()] + [n for n in ("sys/shape", "sys/required", "sys/allowed")]

    def register_views(self, prefix: str = "") -> None:
        """SQL views of the facts with named entities and attributes: facts_named (all) and facts_now (those that hold)."""
        for view, rows in (("facts_named", self.facts()), ("facts_now", self.live())):
            shown = self.named(self.named(rows, "e", "entity"), "a", "attribute")
            shown.select("id", F.coalesce("entity", F.col("e").cast("string")).alias("entity"), "attribute", "t", "i", "d", "s", "b", "f", "tx", "rx").createOrReplaceTempView(prefix + view)

    def datoms(self, index_name: str, components: list = (), source: str = "current", limit: int = 100, cursor: str | None = None) -> dict:
        """A page of an index, and the cursor of the next one."""
        own: list[Any] = []
        for part, x in zip(index.INDEXES.get(index_name, ()), components, strict=False):
            if part == "v" and index_name != "vaet":
                own.append(("ref", self.entity(x["ref"])) if isinstance(x, dict) and set(x) == {"ref"} else V.encode(x))
            else:
                e = self.entity(x["ref"] if isinstance(x, dict) else x)
                if e is None:
                    return {"rows": [], "cursor": None}
                own.append(e)
        rows, more = index.page(self.facts(), index_name, own, source, limit, cursor, self.basis_tx())
        return {"rows": [self._rendered(self._fact(r)) | {"added": r["added"]} for r in rows], "cursor": more}

    def history(self, ref: Any, attribute: str | None = None) -> DataFrame:
        """The facts of an entity over time, with the provenance of their start and end."""
        rows = temporal.history(self.facts(), self._known(ref), self.basis)
        if attribute is not None:
            rows = rows.where(F.col("a") == (self.id_of(attribute) or -1))
        return temporal.with_provenance(rows, self.transactions()).orderBy("tx", "id")

    def why(self, ref: Any, attribute: str | None = None) -> DataFrame:
        """Facts that hold, with everything said about their transaction."""
        rows = self.live().where(F.col("e") == self._known(ref))
        if attribute is not None:
            rows = rows.where(F.col("a") == (self.id_of(attribute) or -1))
        notes = documents(self, rows.select(F.col("tx").alias("e")).distinct(), ["*"]).select(F.col("e").alias("tx"), F.col("doc").alias("transaction"))
        return rows.join(notes, "tx", "left").orderBy("id")

    def diff(self, after: int, upto: int) -> tuple[DataFrame, DataFrame]:
        return temporal.diff(self.facts(), after, upto, self.basis)

    def changes(self, since: int, until: int | None = None) -> tuple[DataFrame, DataFrame]:
        return self.diff(since, self.basis_tx() if until is None else until)

    def receipt(self, tx: int) -> dict:
        r = self.events().where(F.col("tx") == tx).first()
        if r is None:
            raise NotFound(f"no transaction {tx}")
        own = [f for f in self.live_of([tx])]
        out = self._report("applied", r["event"], tx, {}, [], [])
        known = {SYS[n]: n.removeprefix("sys/") for n in ("sys/by", "sys/source", "sys/meta")}
        return {"read_basis_tx": self.basis_tx(), "basis_tx": out["basis_tx"], "tx": tx, "event": r["event"], "event_hash": f"sha256:{r['hash']}", "operation_id": r["operation"], "request_hash": r["request"], "at": out["at"],
                **{known[f.a]: V.render(f.kind, f.value) for f in own if f.a in known}, "tx_facts": {self._shown(f.a): V.render(f.kind, f.value, self._shown(f.value) if f.kind == "ref" else None) for f in own if f.a > RESERVED}}

    def _postings(self) -> str:
        return f"{self.path}/postings/{(self._versions or [''])[-1]}"

    def index_texts(self) -> None:
        """Write a keyword index of the live texts of the present version, which searches use until the next commit."""
        self._writable()
        live = self.live().where(F.col("t").isin(V.TEXT, V.TEXT_REF))
        KeywordIndex.build(live.select(F.col("id").alias("fact"), F.col("s").alias("text")), self._postings(), buckets=4)
        self._memo.pop(("index",), None)

    def _index(self) -> KeywordIndex | None:
        if self._overlay is not None:
            return None
        return self._once(("index",), lambda: KeywordIndex(self.spark, self._postings()) if self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._postings(), "totals/_SUCCESS")) else None)

    def search(self, text: str | None = None, vector: list[float] | None = None, k: int = 10, expand: int = 0, filters: list | None = None, vector_attribute: str | None = None, text_attributes: list[str] | None = None) -> dict:
        """Hits by keyword and vector, fused; with what references reach from them."""
        search.check(text, vector, vector_attribute, text_attributes, filters)
        if self.basis is not None:
            raise Unsupported("search reads the present")
        search.candidate_cap(k)
        live = self.live()
        allowed = None
        for a, wire in filters or []:
            kind, x = ("ref", self.entity(wire["ref"])) if isinstance(wire, dict) and set(wire) == {"ref"} else V.encode(wire)
            s = self.scan(a)
            own = s.df.where(V.equal(s.kind, F.col("v"), kind, V.literal(kind, x))).select("e") if s is not None and x is not None else live.select("e").where(F.lit(False))
            allowed = own if allowed is None else search.filtered(allowed, [own])
        lists = []
        words = live.where(F.col("t").isin(V.TEXT, V.TEXT_REF)).select(F.col("id").alias("fact"), "e", "a", F.col("s").alias("text"))
        if text is not None:
            own = words.where(F.col("a") > RESERVED)
            if text_attributes:
                own = own.where(F.col("a").isin([self.id_of(a) or -1 for a in text_attributes]))
            own = own if allowed is None else own.join(allowed, "e", "left_semi")
            lists.append(search.placed(search.keyword_candidates(own, text, k, words.select("fact", "text"), self._index()), F.col("rank"), F.col("fact")))
        if vector is not None:
            a = self.id_of(vector_attribute)
            d = Planner(self).declared(a) if a is not None else Declared()
            if a is None or d.type != "vector" or (d.dims is not None and d.dims != len(vector)):
                raise ValueTypeError(f"{vector_attribute} holds no vectors of {len(vector)} dimensions")
            own = live.where(F.col("a") == a).select(F.col("id").alias("fact"), "e", F.col("f").alias("v"))
            own = own if allowed is None else own.join(allowed, "e", "left_semi")
            lists.append(search.placed(search.vector_candidates(own, vector, k), F.desc("score"), F.col("fact")))
        named = [self.named(x, "e", "__n").select("e", F.coalesce("__n", F.col("e").cast("string")).alias("name"), "place", "fact") for x in lists]
        hits = search.fused(named, k).collect()
        start = self.spark.createDataFrame([(h["e"],) for h in hits], "e long")
        edges = live.where(F.col("t") == V.REF).select(F.col("id").alias("fact"), F.col("e").alias("src"), F.col("i").alias("dst"))
        reached = [] if not expand or not hits else [{"entity": self._shown(r["e"]), "hop": r["hop"], "path": [self._shown(p) for p in r["path"]]} for r in search.expand(edges, start, expand).collect()]
        docs = {r["e"]: json.loads(r["doc"]) for r in documents(self, start, ["*"]).collect()} if hits else {}
        matched: dict[int, set[int]] = {}
        for x in named:
            for r in x.join(start, "e", "left_semi").select("e", "fact").collect():
                matched.setdefault(r["e"], set()).add(r["fact"])
        wanted = sorted({i for ids in matched.values() for i in ids})
        rows = temporal.with_provenance(live.where(F.col("id").isin(wanted)), self.transactions()).collect() if wanted else []
        proof = {r["id"]: self._evidence(r, text) for r in rows}
        out = {
            "basis_tx": self.basis_tx(),
            "hits": [{"entity": h["name"], "score": h["score"], "matched": [proof[i] for i in sorted(matched[h["e"]])], "pull": search.short(docs[h["e"]])} for h in hits],
            "expanded": reached, "truncated": len(reached) >= search.MOST_EXPANDED,
        }
        return search.bounded(out)

    def _evidence(self, r, text: str | None) -> dict:
        """A matched fact with its provenance: long text cut, of a vector only its size."""
        f = self._fact(r)
        out = self._rendered(f) | {"at": r["at"], "by": r["by"], "source": r["source"]}
        if f.kind == "vector":
            return out | {"v": {"dims": len(f.value)}}
        if f.kind == "text":
            value, cut = capped(f.value)
            out |= {"v": value} | ({"truncated": True} if cut else {}) | ({"snippet": snippet(f.value, text)} if text else {})
        return out

    # ------------------------------------------------------------ schema and health

    def attributes(self, prefix: str = "", system: bool = False) -> list[str]:
        rows = self.ids().where(F.col("name").rlike("^[a-z0-9][a-z0-9._-]*/[a-z0-9][a-z0-9._-]*$") & F.col("name").startswith(prefix))
        rows = rows if system else rows.where(F.col("id") > RESERVED)
        return [r["name"] for r in rows.orderBy("name").collect()]

    def schema(self, prefix: str = "") -> dict:
        """Declared, effective and observed schema, with a digest of the first two and the shapes."""
        seen = {r["a"]: r for r in checks.observed(self.live()).collect()}
        out = []
        for n in self.attributes(prefix):
            a = self.id_of(n)
            d = Planner(self).declared(a)
            declared = {f: getattr(d, f) for f in _FIELDS if getattr(d, f) is not None}
            effective = {"type": d.type, "many": bool(d.many), "unique": bool(d.unique), "nohistory": d.forgets, "dims": d.dims, "doc": d.doc, "vector_model": d.vector_model}
            o = seen.get(a)
            if declared or o:
                out.append({"name": n, "declared": declared, "effective": effective, "observed": {"types": o["types"].split(",") if o else [], "live_facts": o["live_facts"] if o else 0, "entities": o["entities"] if o else 0}})
        shapes = self.shapes()
        core = {"attributes": [{k: x[k] for k in ("name", "declared", "effective")} for x in out], "shapes": shapes}
        return {"basis_tx": self.basis_tx(), "digest": "sha256:" + digest(V.canonical_json(core)), "attributes": out, "shapes": shapes}

    def shapes(self) -> list[dict]:
        rows = self.live().where(F.col("a").isin([SYS[s] for s in ("sys/required", "sys/allowed", "sys/closed")])).collect()
        by: dict[int, dict] = {}
        for r in rows:
            s = by.setdefault(r["e"], {"name": self._shown(r["e"]), "required": [], "allowed": [], "closed": False})
            if r["a"] == SYS["sys/closed"]:
                s["closed"] = bool(r["i"])
            else:
                s["required" if r["a"] == SYS["sys/required"] else "allowed"].append(self._shown(r["i"]))
        return sorted(({**s, "required": sorted(s["required"]), "allowed": sorted(s["allowed"])} for s in by.values()), key=lambda s: s["name"])

    def validate(self, ref: Any) -> list[dict]:
        """What an entity lacks or has beyond its shapes."""
        e = self._known(ref)
        own = self.live_of([e])
        have = {self._shown(f.a) for f in own if f.a > RESERVED}
        shapes, out = {s["name"]: s for s in self.shapes()}, []
        for f in own:
            if f.a == SYS["sys/shape"]:
                s = shapes.get(self._shown(f.value))
                if s is None:
                    out.append({"code": "shape_definition", "shape": self._shown(f.value), "attribute": None})
                    continue
                out += [{"code": "required", "shape": s["name"], "attribute": a} for a in s["required"] if a not in have]
                out += [{"code": "allowed", "shape": s["name"], "attribute": a} for a in sorted(have) if s["closed"] and a not in s["allowed"]]
        return sorted(out, key=lambda v: (v["shape"], v["code"], v["attribute"] or ""))

    def export_schema(self) -> dict:
        """The application's declarations and shapes as a manifest."""
        attributes = [{"name": x["name"], "declared": x["declared"]} for x in self.schema()["attributes"] if x["declared"]]
        return normal_manifest({"format": "schema/1", "attributes": attributes, "shapes": self.shapes()})

    def check_schema(self, manifest: dict) -> dict:
        """What applying a manifest would change."""
        now, wanted = self.export_schema(), normal_manifest(manifest)
        changes = []
        for kind, key in (("attribute", "attributes"), ("shape", "shapes")):
            old, new = ({x["name"]: x for x in m[key]} for m in (now, wanted))
            changes += [{"kind": kind, "name": n, "before": old.get(n), "after": new.get(n)} for n in sorted({*old, *new}) if old.get(n) != new.get(n)]
        try:
            if changes:
                self.speculate().apply_schema(manifest)
            valid = True
        except EngineError:
            valid = False
        return {"basis_tx": self.basis_tx(), "valid": valid, "current_digest": now["digest"], "desired_digest": wanted["digest"], "changes": changes}

    def apply_schema(self, manifest: dict, operation_id: str | None = None, if_basis_tx: int | None = None) -> dict:
        """Replace all declarations and shapes by those of a manifest."""
        self._writable()
        wanted, now = normal_manifest(manifest), self.export_schema()
        old = {x["name"]: x["declared"] for x in now["attributes"]}
        new = {x["name"]: x["declared"] for x in wanted["attributes"]}
        drop = [(n, _FIELDS[f], None) for n, d in old.items() for f in d if f not in new.get(n, {})]
        add = [(n, _FIELDS[f], v) for n, d in new.items() for f, v in d.items()]
        before, after = ({s["name"]: s for s in m["shapes"]} for m in (now, wanted))
        for n, s in before.items():
            goal = after.get(n, {"required": [], "allowed": []})
            drop += [(n, f"sys/{k}", {"ref": a}) for k in ("required", "allowed") for a in s[k] if a not in goal[k]]
            if n not in after:
                drop.append((n, "sys/closed", None))
        add += [(n, f"sys/{k}", a) for n, s in after.items() for k in ("required", "allowed") for a in s[k]] + [(n, "sys/closed", s["closed"]) for n, s in after.items()]
        return self._system_write(add, drop, operation_id=operation_id, if_basis_tx=if_basis_tx, _request={"operation": "schema-apply", "manifest": wanted})

    def stats(self) -> dict:
        """Exact counters of the store; ``size`` is the bytes of its present versions."""
        f, ids = self.facts(), self.ids()
        visible = temporal.visible(f, self.basis)
        named = ids.agg(F.count("*").alias("n"), F.count_if(F.col("name").rlike("^[a-z0-9][a-z0-9._-]*/[a-z0-9][a-z0-9._-]*$")).alias("a")).first()
        events = self.events().count()
        own = F.col("t").isin(V.VECTOR, V.TEXT_REF, V.BYTES_REF)
        counted = f.agg(F.count("*").alias("facts"), F.count_distinct(F.when(own, F.xxhash64("t", "s", "b", "f"))).alias("blobs")).first()
        size = sum(self._fs().getContentSummary(self._path("versions", v)).getLength() for v in self._versions or [])
        return {"application_id": APPLICATION, "size": size, "format_version": 1, "entities": named["n"] - events, "attributes": named["a"], "facts": counted["facts"], "live_facts": visible.count(), "transactions": events, "blobs": counted["blobs"]}

    def doctor(self) -> list[dict]:
        """Violated invariants, each with a number of offending rows; an empty list is health."""
        f, ids, events = self.facts(), self.ids().select(F.col("id").alias("known")), self.events()
        live = temporal.visible(f, self.basis)
        transactions = events.select(F.col("tx").alias("known"))
        found = {
            "fact ids repeat": f.groupBy("id").count().where("count > 1"),
            "an entity is not registered": f.join(ids, F.col("e") == F.col("known"), "left_anti"),
            "an attribute is not registered": f.join(ids, F.col("a") == F.col("known"), "left_anti"),
            "a reference leads nowhere": checks.dangling(f.where(F.col("t") == V.REF).select("e", F.col("i").alias("v")), ids.withColumnRenamed("known", "id")),
            "a fact's transaction is not recorded": f.join(transactions, F.col("tx") == F.col("known"), "left_anti"),
            "a fact's end is not recorded": f.where("rx IS NOT NULL").join(transactions, F.col("rx") == F.col("known"), "left_anti"),
            "a fact ends before it begins": checks.backward(f),
            "a value has no known tag": f.where(~F.col("t").between(0, 10)),
            "a value is not where its tag says": f.where(F.coalesce(F.element_at(F.array(*(F.col(V.FIELD[k]).isNull() for k in V.KIND_OF_TAG)), F.col("t").cast("int") + 1), F.lit(True))),
            "a live fact is there twice": checks.duplicate_facts(live.select("e", "a", V.from_fields("any", {c: F.col(c) for c in ("t", "i", "d", "s", "b", "f")}).alias("v"))),
            "an event does not match its hash": events.where("data IS NOT NULL AND sha2(data, 256) <> hash"),
            "an operation id repeats": events.where("operation IS NOT NULL").groupBy("operation").count().where("count > 1"),
            "names repeat": self.ids().where("name IS NOT NULL").groupBy("name").count().where("count > 1"),
        }
        for a in self.attributes():
            d = Planner(self).declared(self.id_of(a))
            s = self.scan(a)
            if s is None:
                continue
            if d.type is not None and s.kind != d.type:
                found[f"{a} holds another type than {d.type}"] = s.df
            if not d.many:
                found[f"{a} has several values"] = checks.cardinality_violations(s.df)
            if d.unique:
                found[f"{a} is not unique"] = checks.unique_violations(s.df)
        return [{"problem": k, "rows": n} for k, df in found.items() if (n := df.count())]


def normal_manifest(manifest: Any) -> dict:
    """A checked manifest, sorted, with its digest."""
    if not isinstance(manifest, dict) or manifest.get("format") != "schema/1" or set(manifest) - {"format", "digest", "attributes", "shapes"}:
        raise SchemaError("not a schema/1 manifest")
    attributes, shapes = [], []
    for x in manifest.get("attributes", []):
        if not isinstance(x, dict) or set(x) != {"name", "declared"} or not isinstance(x["declared"], dict) or set(x["declared"]) - set(_FIELDS):
            raise SchemaError(f"not an attribute item: {x!r}")
        if x["declared"]:
            attributes.append({"name": check_attribute(x["name"]), "declared": dict(sorted(x["declared"].items()))})
    for x in manifest.get("shapes", []):
        if not isinstance(x, dict) or set(x) != {"name", "required", "allowed", "closed"} or not isinstance(x["closed"], bool):
            raise SchemaError(f"not a shape item: {x!r}")
        required = sorted({check_attribute(a) for a in x["required"]})
        allowed = sorted({check_attribute(a) for a in x["allowed"]} | (set(required) if x["closed"] else set()))
        shapes.append({"name": check_name(x["name"]), "required": required, "allowed": allowed, "closed": x["closed"]})
    for items in (attributes, shapes):
        if len({x["name"] for x in items}) < len(items):
            raise SchemaError("a name comes twice")
        items.sort(key=lambda x: x["name"])
    core = {"format": "schema/1", "attributes": attributes, "shapes": shapes}
    return core | {"digest": "sha256:" + digest(V.canonical_json(core))}
