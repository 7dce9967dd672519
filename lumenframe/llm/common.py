"""Shared pieces of the training-data operators: scratch tables, batching, word hashing and mergeable sketches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Entries a worker's word cache may hold before it is emptied.
CACHE = 200_000
#: Characters handled at once inside a worker.
CHARS = 1 << 20

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all run on this
    machine; else this raises."""
    put = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if put:
        return put.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lumenframe-"))
    return _own[0]


#: Bytes of an Arrow batch that goes to a Python worker while an operator writes its tables.
BATCH = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Whole batches pass through the memory of the JVM and of Python at once, several times over. Within this block they
    are bounded by bytes, not by rows alone; the session's own setting returns after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sweep(spark: SparkSession) -> None:
    """Let the files of finished shuffles go, which Spark deletes once the driver has collected the plans, and the memory
    of the driver's JVM that nothing needs."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Intermediate tables of one operator call, written as Parquet to the shared folder.

    They cut lineage and survive lost executors. ``drop`` deletes tables that no result refers to any more; what is
    left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n, self.paths = 0, []
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        with small_batches(self.spark):
            df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.paths.append(path)
        return out

    def sweep(self) -> None:
        sweep(self.spark)

    def keep(self, *tables: DataFrame) -> None:
        """Drop all tables but these, and the files of shuffles behind them."""
        self.sweep()
        self._delete([p for p in self.paths if p not in {t.scratch_path for t in tables}])

    def drop(self, *tables: DataFrame) -> None:
        try:
            self._delete([t.scratch_path for t in tables] or [self.root])
        except Exception:  # the session may be gone at exit
            if tables:
                raise

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.paths = [p for p in self.paths if p not in paths]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


#: Groups that may be hot: those of more than this part of all rows are no more than this number.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows with the columns of groups(key, n, ...) of their key, nulls if there are none; n is how many rows a group has.

    A group of more than 1 / HOT of all rows would fill one task: these, HOT at most, are broadcast, and their rows stay
    where they are. `groups` is read three times, so it should be a written table.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(groups.where(F.col("n") * HOT > total).drop("n"))
    cold = groups.where(F.col("n") * HOT <= total).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key, "left").select(*rows.join(hot, key).columns))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it was counted to hold no more than `rows` rows of fixed width; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chunked(batches, chars: int = CHARS) -> Iterator[dict[str, list]]:
    """Rows of record batches as dicts of lists, cut so that the column `text` holds about `chars` characters."""
    for b in batches:
        names, start, size = b.schema.names, 0, 0
        text = b.column(names.index("text")).to_pylist()
        for i, t in enumerate(text):
            size += len(t or "")
            if size >= chars or i == len(text) - 1:
                part = b.slice(start, i + 1 - start)
                yield {n: text[start : i + 1] if n == "text" else part.column(k).to_pylist() for k, n in enumerate(names)}
                start, size = i + 1, 0


class WordHash(dict):
    """64-bit hash of a word (bytes), remembered."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def word_hashes(words: list[list[bytes]], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """All documents' word hashes end to end, and where each document starts (one more than documents)."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    get = cache.__getitem__
    return np.fromiter(map(get, chain.from_iterable(words)), np.uint64, int(at[-1])), at


def _odd(seed: int, n: int) -> list[int]:
    """n odd multipliers."""
    out, x = [], (seed * 0x9E3779B97F4A7C15 + 1) & MASK
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        out.append((z ^ (z >> 31)) | 1)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of every k consecutive word hashes; those across documents are to be left out by the caller."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(_odd(seed, k)):
        out += h[j : j + n] * np.uint64(m)
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: Cells per row that a sketch's table is cut into for merging.
CHUNK = 1 << 20
#: A step of a packed list that leads to no number.
SKIP = 0xFFFF


def packed(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as 16-bit steps from one to the next, with a SKIP for each whole SKIP in a longer step."""
    step = np.diff(x, prepend=np.uint32(0))
    skips = step // SKIP
    if not skips.any():
        return step.astype(np.uint16)
    out = np.full(len(x) + int(skips.sum()), SKIP, np.uint16)
    out[np.arange(len(x)) + np.cumsum(skips, dtype=np.int64)] = step % SKIP
    return out


def unpacked(step: np.ndarray) -> np.ndarray:
    return np.cumsum(step, dtype=np.int64)[step != SKIP]


class RepeatSketch:
    """Count-min sketch whose counters stop at two: a window is estimated repeated if all its counters did.

    Counters only ever overestimate, so a window that occurs twice is never missed. Each partition keeps the cells it
    touched, in sorted order; cells are merged by range, and only a bit per cell (two or more) is sent out:
    depth * 2**log_width / 8 bytes, at most `MOST` bits. The width follows the input up to that bound; beyond it the
    estimate lets more windows through to the exact pass, and results stay the same.
    """

    MOST = 29  # log2 of all bits: 64 MB
    schema = "chunk int, once binary, twice binary"

    def __init__(self, depth: int, log_width: int):
        self.depth, self.log = depth, log_width

    @classmethod
    def sized(cls, n_windows: float, depth: int = 2, most: int = MOST) -> RepeatSketch:
        need = max(16, int(np.ceil(np.log2(max(2.0, 4.0 * n_windows)))))
        return cls(depth, min(need, most - int(np.log2(depth))))

    def full(self, n_windows: float) -> bool:
        """Whether so many windows are more than the bound has room for, so that many that occur once pass."""
        return 4.0 * n_windows > 1 << self.log

    def cells(self, h: np.ndarray) -> list[np.ndarray]:
        """For each row of the sketch, the cells of hashes h, counted through all rows."""
        out = []
        for d in range(self.depth):
            x = h if d == 0 else mix(h + np.uint64(d * 0x9E3779B97F4A7C15 & MASK))
            out.append((x >> np.uint64(64 - self.log)).astype(np.int64) + (d << self.log))
        return out

    def partial(self, parts: Iterator[np.ndarray], limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
        """One partition's cells as rows (chunk, cells seen once, cells seen more often)."""
        kept, size = [], 0
        for h in parts:
            for c in self.cells(h):
                kept.append(c.astype(np.uint32))
            size += self.depth * len(h)
            if size >= limit:
                yield self._rows(kept)
                kept, size = [], 0
        if size:
            yield self._rows(kept)

    def _rows(self, kept: list[np.ndarray]) -> pa.RecordBatch:
        c = np.sort(np.concatenate(kept))
        first = np.r_[True, c[1:] != c[:-1]]
        at = np.flatnonzero(first)
        n = np.diff(np.r_[at, len(c)])
        c = c[at]
        chunk = c >> np.uint32(20)
        cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
        rows = [(int(chunk[a]), c[a:b] & np.uint32(CHUNK - 1), n[a:b] > 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        pack = lambda x: packed(x).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([pack(x[~m]) for _, x, m in rows], pa.binary()), pa.array([pack(x[m]) for _, x, m in rows], pa.binary())], ["chunk", "once", "twice"])

    def merged(self, partials: DataFrame) -> np.ndarray:
        """The sketch of all partitions as packed bits, cell i in bit i & 7 of byte i >> 3. Its size is bounded by MOST."""
        width = min(CHUNK, self.depth << self.log)

        def merge(batches):
            at, once, twice = None, None, None

            def row():
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

            for b in batches:
                for chunk, a, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if chunk != at:
                        if at is not None:
                            yield row()
                        at, once, twice = chunk, np.zeros(width, bool), np.zeros(width, bool)
                    for part, many in ((a, False), (t, True)):
                        x = unpacked(np.frombuffer(part, np.uint16))
                        twice[x] |= True if many else once[x]
                        once[x] = True
            if at is not None:
                yield row()

        rows = partials.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary")
        out = np.zeros(max(1, (self.depth << self.log) >> 3), np.uint8)
        for r in rows.toLocalIterator(prefetchPartitions=False):
            out[r.chunk * (width >> 3) : (r.chunk + 1) * (width >> 3)] = np.frombuffer(r.bits, np.uint8)
        return out

    def repeated(self, h: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Mask of the hashes estimated to occur twice or more."""
        out = np.ones(len(h), bool)
        for c in self.cells(h):
            out &= (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        return out


def members(ids: DataFrame, scratch: Scratch, depth: int = 4) -> tuple[Callable[[np.ndarray], np.ndarray], Broadcast]:
    """A mask of 64-bit values that may be among ids(one column), as a function that tasks can call, and the table it
    reads, to be destroyed when done. All that are among them pass; of others few, and more from some 10^8 ids on, as
    the table has 64 MB at most."""
    sketch = RepeatSketch.sized(2.0 * ids.count(), depth)

    def count(batches):
        # each twice, as the sketch tells what occurs twice
        yield from sketch.partial(mix(np.repeat(b.column(0).to_numpy().view(np.uint64), 2)) for b in batches)

    bits = scratch.spark.sparkContext.broadcast(sketch.merged(ids.mapInArrow(count, RepeatSketch.schema)))
    return lambda x: sketch.repeated(mix(x.view(np.uint64)), bits.value), bits


class CountSketch:
    """One row of a count-min sketch with full counts, 2**LOG cells of 4 bytes: tells very frequent items from others."""

    LOG, PART = 20, 1 << 16

    def __init__(self):
        self.counts = np.zeros(1 << self.LOG, np.int64)

    @classmethod
    def cells(cls, h: np.ndarray) -> np.ndarray:
        return (mix(h + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - cls.LOG)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        self.counts += np.bincount(self.cells(h), minlength=1 << self.LOG)

    def rows(self) -> pa.RecordBatch:
        """Rows of the schema of RepeatSketch, under chunks below 0."""
        data = [zlib.compress(np.minimum(self.counts[i : i + self.PART], 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for i in range(0, len(self.counts), self.PART)]
        return pa.RecordBatch.from_arrays([pa.array([-1 - i for i in range(len(data))], pa.int32()), pa.array(data, pa.binary()), pa.array([None] * len(data), pa.binary())], ["chunk", "once", "twice"])

    @classmethod
    def merged(cls, partials: DataFrame) -> np.ndarray:
        def merge(batches):
            at, total = None, None

            def row():
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["chunk", "counts"])

            for b in batches:
                for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if chunk != at:
                        if at is not None:
                            yield row()
                        at, total = chunk, np.zeros(cls.PART, np.int64)
                    total += np.frombuffer(zlib.decompress(data), np.uint32)
            if at is not None:
                yield row()

        out = np.zeros(1 << cls.LOG, np.uint32)
        for r in partials.select("chunk", "once").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, counts binary").toLocalIterator(prefetchPartitions=False):
            out[(-1 - r.chunk) * cls.PART : -r.chunk * cls.PART] = np.frombuffer(r.counts, np.uint32)
        return out


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies, as a table for str.translate: printable bytes
    stand for themselves, the others for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class Pieces:
    """Ids of one pre-token by a byte-level model, without the library's cost of a whole encoding."""

    def __init__(self, tok):
        self.model, self.table = tok.model, byte_letters()

    def __call__(self, word: str) -> list[int]:
        if not word.isascii() or not word.isprintable() or " " in word:
            word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(word)]
