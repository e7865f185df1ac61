"""A library of lessons: an append-only log of versions, and views of it that always name an owner.

A row is a version: (owner_id, id, version, op, ...). The current state of a lesson is its last version's; a column that a
version leaves null keeps its last value. Files are partitioned by owner, so an owner's view reads only its own.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from datetime import datetime
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions import values as v
from quire.session import checkpoint

FIELDS = {"title": "string", "file_name": "string", "created_at": "timestamp_ntz", "last_opened_at": "timestamp_ntz", "domain": "string", "summary_preview": "string", "mode": "string", "data": "string", "audio": "binary", "audio_info": "string", "audio_updated_at": "timestamp_ntz"}
SCHEMA = "id string, version long, op string, " + ", ".join(f"{k} {x}" for k, x in FIELDS.items()) + ", owner_id string"
ORPHAN = "-"


def valid_owner(owner: str | None) -> bool:
    return bool(re.fullmatch(r"[0-9a-f]{32}", owner or ""))


def pick_owner(*candidates: str | None) -> str:
    """The first valid id of a cookie, a link and so on, else a new one."""
    return next((c for c in candidates if valid_owner(c)), None) or uuid.uuid4().hex


def latest(log: DataFrame) -> DataFrame:
    """The current state of every lesson that isn't deleted. What a snapshot holds stands for its version and all before."""
    snapshot = F.col("op") == "snapshot"
    of = Window.partitionBy("id")
    rows = log.withColumn("_since", F.max(F.when(snapshot, F.col("version"))).over(of))
    rows = rows.where(F.col("_since").isNull() | (F.col("version") > F.col("_since")) | (snapshot & (F.col("version") == F.col("_since"))))
    order = of.orderBy("version").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = F.row_number().over(of.orderBy(F.desc("version")))
    rows = rows.select("id", "version", *(F.last(c, ignorenulls=True).over(order).alias(c) for c in (*FIELDS, "owner_id")), F.last("op").over(order).alias("op"), back.alias("_back"))
    return rows.where((F.col("_back") == 1) & (F.col("op") != "delete")).drop("_back", "op")


def owned(log: DataFrame, owner: str) -> DataFrame:
    """The versions of ``log`` (heir, ...) that are an owner's: its own, and those of the orphans whose last heir it is."""
    rows = log.where(F.col("owner_id").isin(owner, ORPHAN)).withColumn("heir", F.max("heir").over(Window.partitionBy("id")))
    return rows.where((F.col("owner_id") == owner) | F.col("heir").eqNullSafe(owner)).drop("heir").withColumn("owner_id", F.lit(owner))


def listed(state: DataFrame) -> DataFrame:
    """What a list of lessons shows, the last opened first; neither texts nor sound are read."""
    shown = state.select("id", "title", "file_name", "created_at", "last_opened_at", "domain", "summary_preview", "mode", F.col("audio").isNotNull().alias("has_audio"), F.coalesce(F.octet_length("audio"), F.lit(0)).alias("audio_bytes"))
    return shown.orderBy(F.coalesce("last_opened_at", "created_at").desc(), "id")


class Library:
    """A folder of versions: one Parquet file a version, named by lesson and number, below its owner.

    A version is written aside and then linked to its name, which fails if the name is there: of two writers that read the
    same version one wins. That needs a file system whose link or rename doesn't replace, as local ones and HDFS have. Every
    file stands by itself, so a writer that is lost leaves nothing but its file aside. Orphans are adopted by a version
    that names their heir.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _owner(self, owner: str) -> str:
        if not valid_owner(owner):
            raise PermissionError("a lesson is read and written only for its owner")
        return owner

    # --- files -------------------------------------------------------------------------------------------------------

    def _at(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, owner: str) -> list[str]:
        at, fs = self._at(f"{self.path}/owner_id={owner}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().endswith(".parquet")) if fs.exists(at) else []

    def _link(self, source: str, target: str) -> bool:
        """``source`` under the name ``target``, unless that is taken; at once and whole."""
        (a, fs), (b, _) = self._at(source), self._at(target)
        fs.mkdirs(b.getParent())
        if fs.getScheme() != "file":
            return fs.rename(a, b)
        try:
            os.link(a.toUri().getPath(), b.toUri().getPath())
        except FileExistsError:
            return False
        return True

    def _publish(self, rows: DataFrame, owner: str, name: str, files: int = 1) -> bool:
        """``rows`` as a file ``name``, or files of that name and a number; false if the name is taken."""
        aside = f"{self.path}/_aside/{uuid.uuid4().hex}"
        rows.drop("owner_id").coalesce(files).write.parquet(aside)
        at, fs = self._at(aside)
        parts = sorted(x.getPath().toString() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-"))
        names = [name] if files == 1 else [f"{name}-{i}" for i in range(len(parts))]
        done = [self._link(p, f"{self.path}/owner_id={owner}/{n}.parquet") for p, n in zip(parts, names, strict=True)]
        fs.delete(at, True)
        return all(done)

    @staticmethod
    def _file(lesson: str, version: int) -> str:
        return f"v-{quote(lesson, safe='').replace('-', '%2D')}-{version:012d}"

    # --- reading -----------------------------------------------------------------------------------------------------

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{SCHEMA}, heir string").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{SCHEMA}, heir string")

    def _rows(self, owner: str) -> DataFrame:
        """The versions that are an owner's: its own, and those of the orphans that it adopted."""
        return owned(self.log(), self._owner(owner))

    def state(self, owner: str) -> DataFrame:
        return latest(self._rows(owner))

    def get(self, owner: str, lesson: str) -> DataFrame:
        return self.state(owner).where(F.col("id") == lesson)

    def audio(self, owner: str, lesson: str) -> bytes | None:
        row = self.get(owner, lesson).select("audio").first()
        return None if row is None or row.audio is None else bytes(row.audio)

    def list(self, owner: str) -> DataFrame:
        return listed(self.state(owner))

    # --- writing -----------------------------------------------------------------------------------------------------

    def _version(self, owner: str, lesson: str, op: str, tries: int = 20, **values: Column) -> bool:
        """One more version of a lesson. Where another writer's comes first it is tried again, unless that one did the same."""
        for _ in range(tries):
            now = self._rows(owner).where(F.col("id") == lesson)
            one = latest(now).select("version").first()
            if one is None:
                return False
            fields = ((values[c].cast(x) if c in values else F.lit(None).cast(x)).alias(c) for c, x in FIELDS.items())
            row = self.spark.range(1).select(F.lit(lesson).alias("id"), F.lit(one.version + 1).cast("long").alias("version"), F.lit(op).alias("op"), *fields, F.lit(None).cast("string").alias("heir"))
            if self._publish(row, owner, self._file(lesson, one.version + 1)):
                over = self._rows(owner).where((F.col("id") == lesson) & (F.col("op") == "snapshot") & (F.col("version") > one.version)).limit(1).count()
                return not over  # a snapshot of a later version was taken before this one had its name
            won = self._rows(owner).where((F.col("id") == lesson) & (F.col("version") == one.version + 1)).select("op").first()
            if won is not None and won.op == op:
                return False
        return False

    def save(self, owner: str | None, title: str | None, data: str, file_name: str = "", domain: str = "", summary: str = "", mode: str = "summary", lesson: str | None = None) -> str:
        lesson = lesson or uuid.uuid4().hex
        owner = ORPHAN if owner is None else self._owner(owner)
        values = {"title": F.lit((title or file_name or v.LESSON).strip() or v.LESSON), "file_name": F.lit(file_name), "created_at": F.localtimestamp(), "domain": F.lit(domain), "summary_preview": t.preview(F.lit(summary)), "mode": F.lit(mode or "summary"), "data": F.lit(data)}
        fields = (values.get(c, F.lit(None)).cast(x).alias(c) for c, x in FIELDS.items())
        row = self.spark.range(1).select(F.lit(lesson).alias("id"), F.lit(1).cast("long").alias("version"), F.lit("save").alias("op"), *fields, F.lit(None).cast("string").alias("heir"))
        if not self._publish(row, owner, self._file(lesson, 1)):
            raise FileExistsError(f"there is a lesson {lesson}")
        return lesson

    def rename(self, owner: str, lesson: str, title: str) -> bool:
        title = (title or "").strip()
        return bool(title) and self._version(owner, lesson, "rename", title=F.lit(title))

    def touch(self, owner: str, lesson: str) -> bool:
        return self._version(owner, lesson, "touch", last_opened_at=F.localtimestamp())

    def set_audio(self, owner: str, lesson: str, audio: bytes, info: str = "") -> bool:
        return self._version(owner, lesson, "audio", audio=F.lit(bytearray(audio)), audio_info=F.lit(info), audio_updated_at=F.localtimestamp())

    def set_data(self, owner: str, lesson: str, data: str) -> bool:
        return self._version(owner, lesson, "data", data=F.lit(data))

    def delete(self, owner: str, lesson: str) -> bool:
        return self._version(owner, lesson, "delete")

    def adopt_orphans(self, owner: str, tries: int = 20) -> int:
        """Lessons without an owner become this owner's; how many. Of two adoptions at a time one takes them all."""
        self._owner(owner)
        for _ in range(tries):
            batch = sum(x.startswith("adopt-") for x in self._names(ORPHAN))
            rows = self.log().where(F.col("owner_id") == ORPHAN)
            free = rows.groupBy("id").agg(F.max("version").alias("version"), F.max("heir").alias("heir"), F.max_by("op", "version").alias("op")).where("heir is null and op <> 'delete'")
            claim = free.select("id", (F.col("version") + 1).alias("version"), F.lit("adopt").alias("op"), *(F.lit(None).cast(x).alias(c) for c, x in FIELDS.items()), F.lit(owner).alias("heir"))
            n = claim.count()
            if not n or self._publish(claim, ORPHAN, f"adopt-{batch:012d}"):
                return n
        return 0

    def compact(self, owner: str, files: int = 1) -> int:
        """One snapshot of an owner's lessons instead of their versions; the number of files that go.

        Snapshots get their names first, then older files go, a deleted lesson's last version the last of all: stopped
        anywhere, the state is the same. Writers may go on; a reader that has begun may have to begin again.
        """
        before = self._names(self._owner(owner))
        rows = self._rows(owner)
        gone = {r.id: r.version for r in rows.groupBy("id").agg(F.max("version").alias("version"), F.max_by("op", "version").alias("op")).where("op = 'delete'").collect()}
        state = checkpoint(latest(rows))
        kept = {r.id: r.version for r in state.select("id", "version").collect()}
        if kept and not self._publish(state.withColumns({"op": F.lit("snapshot"), "heir": F.lit(None).cast("string")}), owner, f"s-{uuid.uuid4().hex}", files):
            return 0
        doomed = [x for x in before if x.startswith("s-")]
        for x in before:
            if x.startswith("v-"):
                lesson, version = unquote(x.split("-")[1]), int(x.split("-")[2].split(".")[0])
                if version <= kept.get(lesson, -1) or version < gone.get(lesson, -1):
                    doomed.append(x)
        for x in doomed:
            at, fs = self._at(f"{self.path}/owner_id={owner}/{x}")
            fs.delete(at, False)
        return len(doomed)

    # --- a lesson's quiz ---------------------------------------------------------------------------------------------

    def quiz(self, owner: str, lesson: str) -> dict | None:
        row = self.get(owner, lesson).select("data").first()
        return json.loads(row.data or "{}").get("quiz") if row else None

    def save_quiz(self, owner: str, lesson: str, questions: list, report: dict) -> bool:
        """New questions for a lesson; its history begins anew."""
        row = self.get(owner, lesson).select("data").first()
        made = {"questions": questions, "report": report, "history": [], "created": datetime.now().isoformat(timespec="seconds")}
        return row is not None and self.set_data(owner, lesson, json.dumps(json.loads(row.data or "{}") | {"quiz": made}, ensure_ascii=False))

    def add_attempt(self, owner: str, lesson: str, score: int, total: int, wrong: list[int], most: int = 20) -> bool:
        """An attempt behind the lesson's last ones; false if it has no questions."""
        row = self.get(owner, lesson).select("data").first()
        data = json.loads(row.data or "{}") if row else {}
        if "quiz" not in data:
            return False
        tried = {"time": datetime.now().isoformat(timespec="seconds"), "score": score, "total": total, "wrong": list(wrong)}
        data["quiz"]["history"] = [*data["quiz"].get("history", ()), tried][-most:]
        return self.set_data(owner, lesson, json.dumps(data, ensure_ascii=False))
