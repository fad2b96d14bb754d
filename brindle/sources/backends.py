"""Object stores and task queues by name, over any file system that Spark reaches."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of stores and the schemes of their addresses.
SCHEMES = {"local": "file", "s3": "s3a", "azure": "abfss"}
#: Seconds after which a message that was received but not acknowledged is there again.
VISIBILITY = 3600.0
TRACE = "traceparent"


class ObjectStore:
    """Objects under a root address, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put_bytes(self, key: str, data: bytes) -> None:
        """Write an object, over one of the same key."""
        path, fs = self._at(key)
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()

    def get_bytes(self, key: str) -> bytes:
        path, fs = self._at(key)
        source = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def exists(self, key: str) -> bool:
        path, fs = self._at(key)
        return fs.exists(path)

    def delete(self, key: str) -> bool:
        path, fs = self._at(key)
        return fs.delete(path, True)

    def move(self, old: str, new: str) -> bool:
        """Rename; False if another one was faster."""
        path, fs = self._at(old)
        return fs.exists(path) and fs.rename(path, self._at(new)[0])

    def entries(self, prefix: str = "") -> list[tuple[str, float]]:
        """(key, time written in seconds) of all objects whose key begins with `prefix`, in order of keys."""
        folder, _, _ = prefix.rpartition("/")
        path, fs = self._at(folder) if folder else self._at(".")
        if not fs.exists(path):
            return []
        found, out = fs.listFiles(path, True), []
        base = fs.makeQualified(self._at(".")[0]).toUri().getPath().rstrip("/")
        while found.hasNext():
            f = found.next()
            key = f.getPath().toUri().getPath()[len(base) + 1 :]
            if key.startswith(prefix) and not key.rpartition("/")[2].startswith("."):
                out.append((key, f.getModificationTime() / 1000.0))
        return sorted(out)

    def list(self, prefix: str = "") -> list[str]:
        return [key for key, _ in self.entries(prefix)]

    def shards(self, prefix: str) -> DataFrame:
        """The vector shards of a prefix, in both of their formats."""
        from brindle.sources.tables import SHARD, npz_shards, shards

        keys, out = self.list(prefix), self.spark.createDataFrame([], SHARD)
        folders = sorted({k.rpartition("/")[0] for k in keys})
        for folder in folders:
            names = [k for k in keys if k.rpartition("/")[0] == folder]
            if any(n.endswith(".npz") for n in names):
                out = out.unionByName(npz_shards(self.spark, f"{self.root}/{folder}"))
            if any(n.endswith(".parquet") for n in names):
                out = out.unionByName(shards(self.spark, f"{self.root}/{folder}").select("batch_id", "start_idx", "work_id", "embedding"))
        return out


def object_store(spark: SparkSession, backend: str, root: str) -> ObjectStore:
    """A store by its backend's name; `root` may leave the scheme to the name."""
    if backend not in SCHEMES:
        raise ValueError(f"unknown object store {backend!r}: one of {', '.join(SCHEMES)}")
    return ObjectStore(spark, root if ":" in root.split("/")[0] else f"{SCHEMES[backend]}://{root}")


@dataclass
class Message:
    """A task as it was sent, and what acknowledges it."""

    body: dict
    receipt: str
    headers: dict[str, str] = field(default_factory=dict)


class FileQueue:
    """A queue in an object store: a message is an object that is moved when it is received, deleted when
    it is acknowledged, and moved back when nothing acknowledged it in time."""

    def __init__(self, store: ObjectStore, topic: str, visibility: float = VISIBILITY):
        self.store, self.topic, self.visibility = store, topic, visibility

    def ensure(self) -> None:
        """Make the topic if it isn't there."""
        if not self.store.exists(f"{self.topic}/topic.json"):
            self.store.put_bytes(f"{self.topic}/topic.json", b"{}")

    def send(self, body: dict, headers: dict[str, str] | None = None) -> str:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        self.store.put_bytes(f"{self.topic}/new/{name}", json.dumps({"body": body, "headers": headers or {}}).encode())
        return name

    def receive(self, max_messages: int = 1) -> list[Message]:
        """At most so many messages, the oldest first; two receivers never get the same one in time."""
        now = time.time()
        for key in self.store.list(f"{self.topic}/taken/"):
            name, _, until = key.rpartition("/")[2].rpartition("@")
            if float(until) <= now:
                self.store.move(key, f"{self.topic}/new/{name}")
        out: list[Message] = []
        for key in self.store.list(f"{self.topic}/new/"):
            if len(out) >= max_messages:
                break
            name = key.rpartition("/")[2]
            receipt = f"{self.topic}/taken/{name}@{now + self.visibility:.3f}"
            folder, fs = self.store._at(f"{self.topic}/taken")
            fs.mkdirs(folder)
            if self.store.move(key, receipt):
                read = json.loads(self.store.get_bytes(receipt))
                out.append(Message(read["body"], receipt, read["headers"]))
        return out

    def ack(self, message: Message) -> bool:
        return self.store.delete(message.receipt)

    def close(self) -> None:
        """Nothing is held open."""


class KafkaQueue:
    """Tasks in a Kafka topic, by Spark's Kafka source and sink. What was received is acknowledged by
    storing the offsets after it; the topic's producers and its partitions are the cluster's."""

    def __init__(self, store: ObjectStore, topic: str, servers: str):
        self.store, self.topic, self.servers, self.spark = store, topic, servers, store.spark

    def ensure(self) -> None:
        """Brokers make topics on the first message, where they are set to."""

    def send(self, body: dict, headers: dict[str, str] | None = None) -> None:
        from brindle.sources.tables import to_kafka

        row = [(str(body.get("batch_id", "")), json.dumps(body), list((headers or {}).items()))]
        to_kafka(self.spark.createDataFrame(row, "key string, value string, headers array<struct<key:string,value:string>>"), self.servers, self.topic)

    def receive(self, max_messages: int = 1) -> list[Message]:
        key = f"{self.topic}/offsets.json"
        start = self.store.get_bytes(key).decode() if self.store.exists(key) else "earliest"
        raw = self.spark.read.format("kafka").options(**{"kafka.bootstrap.servers": self.servers, "subscribe": self.topic, "startingOffsets": start, "includeHeaders": "true"}).load()
        rows = raw.orderBy("timestamp", "partition", "offset").limit(max_messages).collect()
        out = []
        for r in rows:
            head = {h["key"]: bytes(h["value"]).decode() for h in r["headers"] or []}
            out.append(Message(json.loads(bytes(r["value"])), f"{r['partition']}:{r['offset'] + 1}", head))
        return out

    def ack(self, message: Message) -> bool:
        key = f"{self.topic}/offsets.json"
        known = json.loads(self.store.get_bytes(key)) if self.store.exists(key) else {}
        partition, offset = message.receipt.split(":")
        mine = known.setdefault(self.topic, {})
        mine[partition] = max(int(offset), mine.get(partition, 0))
        self.store.put_bytes(key, json.dumps(known).encode())
        return True

    def close(self) -> None:
        """Nothing is held open."""


def get_queue(store: ObjectStore, backend: str, topic: str, servers: str = "", visibility: float = VISIBILITY) -> FileQueue | KafkaQueue:
    """A queue by its backend's name."""
    if backend == "kafka":
        return KafkaQueue(store, topic, servers)
    if backend in ("local", "files", "azure"):
        return FileQueue(store, topic, visibility)
    raise ValueError(f"unknown queue {backend!r}: one of local, files, azure, kafka")


def trace_headers(trace_id: str | None = None, span_id: str | None = None) -> dict[str, str]:
    """The trace context of a task, a new one without a trace."""
    return {TRACE: f"00-{trace_id or uuid.uuid4().hex}-{span_id or uuid.uuid4().hex[:16]}-01"}


def trace_of(headers) -> object:
    """The trace id in a column of message headers (key, value as bytes or text); null without one."""
    value = F.get(F.filter(headers, lambda h: h["key"] == TRACE), F.lit(0))["value"].cast("string")
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), r"^[0-9a-f]{2}-([0-9a-f]{32})-", 1), F.lit(""))
