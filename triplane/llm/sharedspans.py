"""Long exact spans shared between records, found through compact windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..runtime import discard, materialize

#: A shared stretch is looked for by substrings that hold its anchor token, one for each of so many parts of the places
#: the token may have in it. The more, the longer they are, and the fewer stretches are compared.
PROBES = 8
#: Characters handled at once in a task, which bounds its memory; so many that their hashes stay in a core's cache.
CHARS_AT_ONCE = 60_000



def token_size(length: int) -> int:
    """Characters of a token, the text at any offset; a stretch of ``length`` characters holds length - size + 1.

    Longer tokens are met less often by chance, shorter ones give fewer windows: some 2 n / (length - size + 2) for n
    characters.
    """
    if length < 1:
        raise ValueError(f"a stretch has one character or more, not {length}")
    return max(1, length * 3 // 7)


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def token_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` characters from each offset, in log(size) passes: blocks of 2^k are pairs of 2^(k-1).

    Sums of products are enough, mixed before and after: equal tokens have equal hashes, and tokens that share one by
    chance only cost a comparison later.
    """
    power, at, got, done = _mixed(chars.astype(np.uint64) + _M2), 1, None, 0
    while True:
        if size & at:
            if got is None:
                got, done = power, at
            else:
                m = min(len(got), len(power) - done)
                got = got[:m] * _M3 + power[done : done + m]
                done += at
        at *= 2
        if at > size:
            return _mixed(got[: max(0, len(chars) - size + 1)])
        half = at // 2
        if len(power) > half:
            up = power[:-half] * (_M1 + np.uint64(2 * at))
            up += power[half:]
            power = up
        else:
            power = power[:0]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, in three passes whatever the width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    cut = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(cut, axis=1).ravel()
    back = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def compact_windows(chars: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The compact windows of texts laid end to end: first start, number of starts, place and hash of the least token.

    A stretch is ``length`` characters of one text; its signature is the least of its tokens' hashes, the leftmost on
    ties. Following stretches that owe their signature to the same token form one window. These are the nodes of the
    Cartesian tree over the token hashes that are wide enough for a stretch: a node's token is the least of exactly
    the stretches that lie in its interval and hold it. Each stretch is in one window.
    """
    size = token_size(length)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(chars) < length:
        return none
    hashes = token_hashes(chars, size)
    place = np.arange(len(hashes), dtype=np.uint64)
    # High bits of the hash, then the place: the least is the leftmost among equals. Both keep their order when the
    # stretch stands elsewhere, so equal stretches choose the same token.
    least = (sliding_least((hashes & ~np.uint64(0xFFFFFF)) | place, length - size + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(owner[: len(least)] == owner[length - 1 : length - 1 + len(least)])
    if not len(starts):
        return none
    token = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (token[1:] != token[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), token[at], hashes[token[at]]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list]]:
    """Rows in parts of at most CHARS_AT_ONCE characters, longer texts alone."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        ids, texts, rest, held = [], [], [], 0
        for row in zip(*columns, strict=True):
            if ids and held + len(row[1]) > CHARS_AT_ONCE:
                yield ids, texts, rest
                ids, texts, rest, held = [], [], [], 0
            ids.append(row[0])
            texts.append(row[1])
            rest.append(row[2:])
            held += len(row[1])
        if ids:
            yield ids, texts, rest


def _pieces(text: str, length: int) -> Iterator[tuple[int, str]]:
    """A text longer than CHARS_AT_ONCE in parts that share length - 1 characters, so that no stretch is lost."""
    step = CHARS_AT_ONCE - length + 1
    for at in range(0, max(1, len(text) - length + 1), step):
        yield at, text[at : at + CHARS_AT_ONCE]


def _chars(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


_WINDOWS = "doc long, first long, starts int, at int, anchor long"


def windows_of(docs: DataFrame, doc: str, text: str, length: int) -> DataFrame:
    """The compact windows of every text: its first start, its starts, the place ``at`` of its anchor token from the
    first start, and the token's hash. A map over the rows."""
    schema = StructType.fromDDL(_WINDOWS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in _texts(batches):
            whole = [(i, 0, t) for i, t in zip(ids, texts, strict=True)] if len(texts) > 1 else [(ids[0], at, t) for at, t in _pieces(texts[0], length)]
            for part in [whole] if len(texts) > 1 else [[x] for x in whole]:
                sizes = np.array([len(t) for _, _, t in part])
                begin = np.cumsum(sizes) - sizes
                first, count, token, anchor = compact_windows(_chars([t for _, _, t in part]), np.repeat(np.arange(len(part)), sizes), length)
                if not len(first):
                    continue
                own = np.searchsorted(begin, first, "right") - 1
                doc_ids = np.array([i for i, _, _ in part], np.int64)[own]
                moved = np.array([at for _, at, _ in part], np.int64)[own]
                columns = [doc_ids, first - begin[own] + moved, count, token - first, anchor.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND length(text) >= %d" % length).mapInArrow(run, schema)


def _bodies(docs: DataFrame, windows: DataFrame, doc: str, text: str, length: int) -> DataFrame:
    """``doc, first, starts, at, body``: the windows with the characters they cover. A text's windows fit where it fits."""
    schema = StructType.fromDDL("doc long, first long, starts int, at int, body string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for d, t, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in of:
                    first, starts = w["first"], w["starts"]
                    out.append((d, first, starts, w["at"], t[first : first + starts - 1 + length]))
                    held += starts + length
                    if held > CHARS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    per_doc = windows.groupBy("doc").agg(F.collect_list(F.struct("first", "starts", "at")).alias("windows"))
    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).join(per_doc, "doc").select("doc", "text", "windows").mapInArrow(run, schema)


def _equal(a: Column, b: Column, value: Column) -> Column:
    """``value``, if the texts are equal; they always are unless a 128-bit hash stands for two texts."""
    return F.when(a == b, value).otherwise(F.raise_error(F.lit("two different texts have the same hash of 128 bits")))


def shared_spans(docs: DataFrame, doc: str, text: str, length: int) -> DataFrame:
    """``doc, span_start, span_end``: the characters that lie in any stretch of ``length`` which another text holds too.

    Stretches of one text that overlap or touch are joined. Offsets count Unicode code points from 0, the end is
    exclusive; nothing is normalised. A stretch repeated in one text only is not shared. NULL texts, NULL ids and texts
    shorter than ``length`` have none. ``doc`` identifies a text: rows that repeat it must hold equal texts.

    Equal stretches hold equal tokens, so they fall into windows with equal anchor tokens: one hash function finds
    every pair of them (near-duplicates would need several). Windows are made without their characters, and those whose
    anchor stands in one text only are dropped before any characters are taken. The others are handled in classes:

    1. Windows with the same characters form a class; only the number of texts is kept, as the least and greatest id,
       added up map-side. A class of two or more texts is shared as a whole.
    2. Classes may agree in part, at the edges of copied passages. The places an anchor may have in a stretch are cut
       into PROBES parts; all stretches of a window whose anchor lies in one part hold a common substring, so two
       classes that share such a stretch have equal ones. Where equal substrings join classes of two or more texts, one
       of them from one text only, each class gives the characters of its stretches of that part, its piece. Equal
       pieces are one again; a piece of two or more texts is shared.
    3. Where a part still has a piece of one text only, its pieces give the hashes of their stretches. A stretch whose
       pieces stand in two or more texts is shared.
    4. Verification by characters: classes and pieces by the least and greatest of their members' characters, the runs
       of shared stretches by an interval join of each piece with the first piece that holds them.
    5. The verdict on a piece goes back to its classes, and that on a class to all its windows.

    No step pairs texts: a passage in a third of all texts is one class.
    """
    size = token_size(length)
    width = length - size + 1
    every = materialize(windows_of(docs, doc, text, length), "windows")
    anchors = every.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor")
    met = materialize(every.join(anchors, "anchor", "left_semi").select("doc", "first", "starts", "at"), "met")
    discard(every)
    cls = ["c1", "c2"]
    hashes = lambda body: (F.xxhash64(body), F.xxhash64(F.lit(1), body))
    c1, c2 = hashes(F.col("body"))
    w = materialize(_bodies(docs, met, doc, text, length).select("doc", "first", "starts", "at", c1.alias("c1"), c2.alias("c2"), "body"), "bodies")
    discard(met)
    texts = [F.min("doc").alias("lo"), F.max("doc").alias("hi")]
    # Equal characters choose the same anchor and hold as many starts.
    classes = w.groupBy(*cls).agg(*texts, F.min("starts").alias("starts"), F.min("at").alias("at"), F.min("body").alias("body"), F.max("body").alias("last"))
    classes = materialize(classes.withColumn("body", _equal(F.col("body"), F.col("last"), F.col("body"))).drop("last").withColumn("id", F.monotonically_increasing_id()), "classes")

    bounds = [width * k // PROBES for k in range(PROBES + 1)]
    probes, begins, ends = [], [], []
    for low, high in zip(bounds, bounds[1:], strict=False):
        # Stretches whose anchor lies from ``low`` up to ``high`` all hold the text from ``low`` before the anchor.
        begin, end = F.greatest(F.lit(0), F.col("at") - (high - 1)), F.least(F.col("starts") - 1, F.col("at") - low)
        begins.append(begin)
        ends.append(end)
        probes.append(F.when(begin <= end, F.xxhash64(F.substring("body", F.col("at") - low + 1, F.lit(low + size + width - high)))))
    side = ["part", "probe"]

    def unsettled(df: DataFrame) -> DataFrame:
        """Rows of those parts and probes that join two or more texts, and have a row of one text only."""
        seen = df.groupBy(*side).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lo") == F.col("hi")).alias("single"), F.min("lo").alias("slo"), F.max("hi").alias("shi"))
        return df.join(seen.where("n > 1 AND single > 0 AND slo < shi").select(*side), side, "left_semi")

    sides = unsettled(classes.select("id", "lo", "hi", F.posexplode(F.array(*probes)).alias("part", "probe")).where("probe IS NOT NULL"))
    pick = lambda columns: F.element_at(F.array(*columns), F.col("part") + 1)
    pieces = classes.join(sides.select("id", *side), "id").select(*cls, "lo", "hi", *side, "body", pick(begins).alias("begin"), (pick(ends) - pick(begins) + 1).alias("starts"))
    pieces = pieces.withColumn("body", F.substring("body", F.col("begin") + 1, F.col("starts") + (length - 1)))
    p1, p2 = hashes(F.col("body"))
    pieces = materialize(pieces.withColumns({"p1": p1, "p2": p2}), "pieces")
    piece = [*side, "p1", "p2"]
    whole = pieces.groupBy(*piece).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("starts").alias("starts"), F.min("body").alias("body"), F.max("body").alias("last"))
    whole = materialize(whole.withColumn("body", _equal(F.col("body"), F.col("last"), F.col("body"))).drop("last").withColumn("id", F.monotonically_increasing_id()), "whole")

    s1, s2 = hashes(F.substring("body", F.col("place") + 1, F.lit(length)))
    places = unsettled(whole).select("id", "lo", "hi", "body", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("place"))
    st = materialize(places.select("id", "lo", "hi", "place", s1.alias("s1"), s2.alias("s2")), "stretches")
    both = st.groupBy("s1", "s2").agg(F.min("lo").alias("slo"), F.max("hi").alias("shi"), F.min("id").alias("lead"), F.min_by("place", "id").alias("at")).where("slo < shi").select("s1", "s2", "lead", "at")
    hits = st.join(both, ["s1", "s2"]).select("id", "place", "lead", (F.col("at") - F.col("place")).alias("moved"))
    pair = ["id", "lead", "moved"]
    run = F.col("place") - F.row_number().over(Window.partitionBy(*pair).orderBy("place"))
    runs = hits.withColumn("run", run).groupBy(*pair, "run").agg(F.min("place").alias("from"), F.max("place").alias("to"))
    long = F.col("to") - F.col("from") + length
    same = _equal(F.substring("body", F.col("from") + 1, long), F.substring("led", F.col("from") + F.col("moved") + 1, long), F.col("to"))
    # Pieces of several texts are shared whole already; their runs are verified with the others, as they may lead them.
    proven = runs.join(whole, "id").join(whole.select(F.col("id").alias("lead"), F.col("body").alias("led")), "lead").select(*piece, "lo", "hi", "from", same.alias("to")).where("to IS NOT NULL AND lo = hi").select(*piece, "from", "to")
    settled = whole.where("lo < hi").select(*piece, F.lit(0).alias("from"), (F.col("starts") - 1).alias("to"))
    partial = pieces.where("lo = hi").join(settled.unionByName(proven), piece).select(*cls, (F.col("begin") + F.col("from")).alias("from"), (F.col("begin") + F.col("to")).alias("to"))
    verdicts = materialize(classes.where("lo < hi").select(*cls, F.lit(0).alias("from"), (F.col("starts") - 1).alias("to")).unionByName(partial), "verdicts")
    discard(classes, pieces, whole, st)
    # A text may hold a window's characters more than once: the verdict goes to each place.
    parts = w.join(verdicts, cls).select("doc", (F.col("first") + F.col("from")).alias("a"), (F.col("first") + F.col("to") + length).alias("b"))
    order = Window.partitionBy("doc").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = parts.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy("doc", "island").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).select(F.col("doc").alias(doc), "span_start", "span_end")


def shared_share(docs: DataFrame, spans: DataFrame, doc: str, text: str) -> DataFrame:
    """Per text its characters, those in shared spans, and the fraction; texts without characters have fraction 0."""
    per = spans.groupBy(doc).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("spans"))
    chars = F.coalesce(F.length(text), F.lit(0))
    got = docs.select(F.col(doc).cast("long").alias(doc), chars.cast("long").alias("n_chars")).join(per, doc, "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return got.select(doc, "n_chars", shared.alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_fraction"))
