"""Removal of repeated byte strings by a distributed suffix sort over a difference cover.

A difference cover is a set of places such that any two equal strings of
``LENGTH`` bytes have a common shift at which both are in the set; then only
suffixes at those places need a full sort, and every other suffix is ordered
by the few bytes before the next such place and that place's rank.  Fixed
residues (two of three places) sort two thirds of all suffixes.  Here the
cover is chosen by content: of the ``LENGTH - GRAM + 1`` triples of 8-byte
words inside a string, the place of the least hash is taken, so equal strings
take the same place and about one place in fourteen is sampled.

1. Triples: each sampled place's triple is hashed; hashes are combined per
   batch, dealt over buckets and named there.  A name that one document alone
   has cannot be part of a repeat, and its places are dropped.
2. The places left are dealt by their triple, each with the bytes of its own
   strings (at most 26 before and 26 behind the triple).  Each bucket sorts its sampled suffixes and takes the
   common prefix of neighbours; names of depth ``LENGTH - s`` are the runs
   where that prefix is long enough.  Since strings are ``LENGTH`` bytes, one
   level of names settles them.
3. The other suffixes, ``s`` bytes before a sampled place, are merged in by
   the pair (name of the ``s`` bytes before, name of the suffix behind).
4. In every run of equal prefixes the least doc_id is found; a string that
   also starts in a document with a smaller one is removed.

Equal contexts are combined within a batch before they travel, so a passage
or copy in a third of all documents sends one row a batch.  Triples shared by
more than ``hot_docs`` documents, whose contexts may all differ, are dealt by
their whole strings instead.  No step sees more than a bucket's share.

Defined results: null text is empty; texts under ``LENGTH`` bytes are kept
whole; a null doc_id counts as smaller than any other; rows with one doc_id
do not remove from each other; an empty table gives no rows; extra columns
pass through and those named like a result give way to it.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, ship_package
from .memory import give_back

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # triples inside one string
#: Bytes handled by numpy at a time.
CHUNK = 1 << 18
#: Documents whose names are combined before they travel.
BATCH_DOCS = 2500
#: Documents in one group of texts.
GROUP_DOCS = 500
HOT_DOCS = 50_000
_NULL = -(1 << 63)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(v: np.ndarray) -> np.ndarray:
    v = v * _M
    return v ^ (v >> np.uint64(32))


def samples(texts: list[bytes]):
    """Yield (text indices, first string, last string, place, hash) of the sampled places, chunk by chunk."""
    held, size = [], 0
    for k, t in enumerate(texts):
        if len(t) >= LENGTH:
            held.append(k)
            size += len(t)
        if held and (size >= CHUNK or k == len(texts) - 1):
            yield _samples(texts, held)
            held, size = [], 0
    if held:
        yield _samples(texts, held)


def _samples(texts, held):
    sizes = np.array([len(texts[k]) for k in held], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    b = np.frombuffer(b"".join(texts[k] for k in held) + bytes(32), dtype=np.uint8).astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        b = b[:-step] | (b[step:] << np.uint64(shift))
    h = _mix(_mix(_mix(b[:total]) ^ b[8 : total + 8]) ^ b[16 : total + 16])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(total, dtype=np.uint64)
    least, width = key[: total - GRAM + 1], 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    ok = np.ones(len(least), dtype=bool)
    for end in (starts + sizes)[:-1].tolist():
        ok[end - LENGTH + 1 : end] = False
    first = np.flatnonzero(ok)
    place = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    lo, hi, at = first[head], first[np.r_[head[1:], len(first)] - 1], place[head]
    text = np.searchsorted(starts, lo, "right") - 1
    base = starts[text]
    return np.array(held)[text], lo - base, hi - base, at - base, (h[at] >> np.uint64(16)).astype(np.int64)


def _press(*arrays: np.ndarray) -> bytes:
    """Columns of numbers, byte plane by byte plane: the planes of zeros above small numbers cost nothing."""
    import zstandard

    planes = [np.ascontiguousarray(a, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _table(blob: bytes, columns: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(columns, -1)


def _steps(ascending: np.ndarray) -> np.ndarray:
    """First number and the differences: small where neighbours are near."""
    return np.diff(ascending, prepend=0)


def _texts(pdf: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    ids = np.array([_NULL if pd.isna(d) else int(d) for d in pdf["__doc"].tolist()], dtype=np.int64)
    return ids, [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"].tolist()]


def _by(part: np.ndarray, *columns: np.ndarray):
    """(part, columns of its rows), part by part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield int(part[i]), [c[order[i:j]] for c in columns]


def _lean_pair(run):
    """A grouped function that gives its memory back."""

    def lean(key, left, right):
        out = run(key, left, right)
        give_back()
        return out

    return lean


def _lean(run):
    """The same for one group."""

    def lean(key, pdf):
        out = run(key, pdf)
        give_back()
        return out

    return lean


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _triples(buckets: int, groups: int):
    """Names of one batch: (hash, least doc, greatest doc, documents) dealt by hash; shared ones found here go on to their documents."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BATCH_DOCS):
                out = names(*_texts(pdf.iloc[at : at + BATCH_DOCS]))
                give_back()
                if out:
                    yield pd.DataFrame(out, columns=["bucket", "blob"])

    def names(ids, texts):
        found = [(ids[k], h) for k, _, _, _, h in samples(texts)]
        if not found:
            return []
        doc, h = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        doc, h = doc[once], h[once]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[head, len(h)])
        out = [(b, _press(_steps(hs), lo, hi - lo, m)) for b, (hs, lo, hi, m) in _by(h[head] % buckets, h[head], doc[head], doc[head + n - 1], n)]
        many = np.repeat(n > 1, n)
        return out + [(-1 - g, _press(*c)) for g, c in _by(_group(doc[many], groups), doc[many], h[many])]

    return run


def _shared(groups: int, hot_docs: int):
    """Documents' shared triples by group of documents; hot triples by themselves (group -1)."""

    def run(key, pdf):
        if key[0] < 0:
            return pd.DataFrame({"grp": [-1 - int(key[0])] * len(pdf), "blob": pdf["blob"]})
        tables = [_table(b, 4) for b in pdf["blob"]]
        h = np.concatenate([np.cumsum(t[0]) for t in tables])
        lo, more, n = np.concatenate([t[1:] for t in tables], axis=1)
        hi = lo + more
        order = np.argsort(h, kind="stable")
        h, lo, hi, n = h[order], lo[order], hi[order], n[order]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[head, len(h)])
        shared = np.repeat(np.minimum.reduceat(lo, head) < np.maximum.reduceat(hi, head), size) & (n == 1)
        total = np.add.reduceat(n, head)
        out = [(g, _press(*c)) for g, c in _by(_group(lo[shared], groups), lo[shared], h[shared])]
        hot = h[head][total > hot_docs]
        if len(hot):
            out.append((-1, _press(hot)))
        return pd.DataFrame(out, columns=["grp", "blob"])

    return run


def _contexts(buckets: int, groups: int, hot: np.ndarray):
    """Strings around each shared place, dealt by triple; repeats within this batch are settled here."""
    import zstandard

    def run(key, pdf, hits):
        ids, texts = _texts(pdf)
        out = []
        if not len(hits):
            return pd.DataFrame(out, columns=["bucket", "rows", "bytes"])
        doc, h = np.concatenate([_table(b, 2) for b in hits["blob"]], axis=1)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        least: dict[tuple[bytes, int], int] = {}
        rows: list[tuple[int, int, int, int, bytes]] = []
        wanted = pd.MultiIndex.from_arrays([doc, h]).unique()
        for k, lo, hi, at, hs in samples(texts):
            keep = pd.MultiIndex.from_arrays([ids[k], hs]).isin(wanted)
            is_hot = np.isin(hs, hot)
            for t, a, z, p, g, w in zip(*(x[keep].tolist() for x in (k, lo, hi, at, hs, is_hot))):
                text, d = texts[t], int(ids[t])
                # A hot triple goes string by string, dealt by the string.
                for i, j in ((q, q) for q in range(a, z + 1)) if w else ((a, z),):
                    s = text[i : j + LENGTH]
                    off = p - i
                    rows.append((d, i, off, _crc(s) % buckets if w else g % buckets, s))
                    old = least.get((s, off))
                    if old is None or d < old:
                        least[s, off] = d
        gone, sent = [], {}
        for d, i, off, b, s in rows:
            if d > least[s, off]:
                gone.append((d, i, i + len(s)))
            else:
                sent.setdefault(b, []).append((d, i, off, s))
        press = zstandard.ZstdCompressor(level=1)
        for b, own in sent.items():
            own.sort(key=lambda r: r[3])
            cols = [np.array([r[c] for r in own], dtype=np.int64) for c in range(3)] + [np.array([len(r[3]) for r in own], dtype=np.int64)]
            out.append((b, _press(*cols), press.compress(b"".join(r[3] for r in own))))
        if gone:
            d, a, z = np.array(gone, dtype=np.int64).T
            out.append((-1 - int(key[0]), _press(*_merged(d, a, z)), None))
        return pd.DataFrame(out, columns=["bucket", "rows", "bytes"])

    return run


def _crc(s: bytes) -> int:
    import zlib

    return zlib.crc32(s)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Ranges of each document, those that overlap or touch as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    # A running end within each document, by lifting each document above the last.
    lift = (np.cumsum(new_doc) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    head = np.flatnonzero(np.r_[True, new_doc[1:] | (start[1:] + lift[1:] > reach[:-1])])
    return doc[head], start[head], (reach - lift)[np.r_[head[1:], len(doc)] - 1]


def _neighbours(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and the common prefix of each with the one before."""
    a = np.array(strings, dtype=f"S{width}")
    order = np.argsort(a, kind="stable")
    m = a[order].view(np.uint8).reshape(len(a), width)
    same = np.ones((len(a), width + 1), dtype=bool)
    same[:, width] = False
    same[0, 0] = False
    same[1:, :width] = m[1:] == m[:-1]
    return order, np.argmin(same, axis=1)


def repeats(contexts: list[tuple[bytes, int]], least: np.ndarray) -> np.ndarray:
    """(context, string) -> whether the string starts in a smaller document than the context's least."""
    n = len(contexts)
    out = np.zeros((n, SPAN), dtype=bool)
    off = np.array([o for _, o in contexts], dtype=np.int64)
    strings = np.array([len(c) for c, _ in contexts], dtype=np.int64) - LENGTH + 1
    right, r_common = _neighbours([c[o : o + LENGTH] for c, o in contexts], LENGTH)
    left, l_common = _neighbours([c[:o][::-1] for c, o in contexts], SPAN)
    name_r, name_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for s in range(SPAN):
        own = np.flatnonzero((off >= s) & (off - s < strings))
        if len(own) < 2:
            continue
        name_r[right] = np.cumsum(r_common < LENGTH - s)
        name_l[left] = np.cumsum(l_common < s)
        pair = (name_r[own] << 32) | name_l[own]
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        head = np.flatnonzero(np.r_[True, sorted_pair[1:] != sorted_pair[:-1]])
        low = np.repeat(np.minimum.reduceat(least[own[order]], head), np.diff(np.r_[head, len(own)]))
        hit = own[order][low < least[own[order]]]
        out[hit, off[hit] - s] = True
    return out


def _sorted(groups: int):
    """Ranges to remove, by group of documents, from one bucket of contexts."""
    import zstandard

    def run(key, pdf):
        if key[0] < 0:
            return pd.DataFrame({"grp": [-1 - int(key[0])] * len(pdf), "blob": pdf["rows"]})
        un, number, least, parts = zstandard.ZstdDecompressor(), {}, [], []
        for rows, packed in zip(pdf["rows"], pdf["bytes"]):
            doc, start, off, size = _table(rows, 4)
            text, ends = un.decompress(packed), np.cumsum(size).tolist()
            which = []
            for d, o, n, end in zip(doc.tolist(), off.tolist(), size.tolist(), ends):
                c = (text[end - n : end], o)
                k = number.setdefault(c, len(number))
                if k == len(least):
                    least.append(d)
                elif d < least[k]:
                    least[k] = d
                which.append(k)
            parts.append((doc, start, size, np.array(which, dtype=np.int64)))
        low = np.array(least, dtype=np.int64)
        mask = repeats(list(number), low)
        doc, start, size, which = (np.concatenate(x) for x in zip(*parts))
        gone = mask[which] | (doc > low[which])[:, None]
        gone &= np.arange(SPAN) < (size - LENGTH + 1)[:, None]
        row, j = np.nonzero(gone)
        doc, start, end = _merged(doc[row], start[row] + j, start[row] + j + LENGTH)
        return pd.DataFrame([(g, _press(*c)) for g, c in _by(_group(doc, groups), doc, start, end)], columns=["grp", "blob"])

    return run


def _cut(columns: list[str]):
    def run(key, pdf, gone):
        ids, texts = _texts(pdf)
        doc = start = end = np.zeros(0, np.int64)
        if len(gone):
            doc, start, end = _merged(*np.concatenate([_table(b, 3) for b in gone["blob"]], axis=1))
        kept, begins, stops = [], [], []
        for d, t in zip(ids.tolist(), texts):
            i, j = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
            # Rows with one doc_id share ranges; each takes those inside its own text.
            own = [(a, z) for a, z in zip(start[i:j].tolist(), end[i:j].tolist()) if z <= len(t)]
            at, left = 0, []
            for a, z in own:
                left.append(t[at:a])
                at = z
            kept.append(b"".join(left) + t[at:])
            begins.append([a for a, _ in own])
            stops.append([z for _, z in own])
        out = pdf[columns].copy()
        out["kept"], out["span_starts"], out["span_ends"] = kept, begins, stops
        return out

    return run


def release_shuffles(spark) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, checkpointed steps now, not at the driver's next full collection."""
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def remove_repeats(docs: DataFrame, buckets: int | None = None, hot_docs: int = HOT_DOCS) -> DataFrame:
    """``docs`` with ``kept`` (bytes left, in order), ``span_starts`` and ``span_ends`` (removed bytes)."""
    spark = docs.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    columns = [c for c in docs.columns if c not in ("kept", "span_starts", "span_ends")]
    # Nullable whole numbers keep their digits on their way through pandas.
    whole = {f.name: f.dataType for f in docs.schema.fields if isinstance(f.dataType, T.IntegralType)}
    rows = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in whole else F.col(f"`{c}`") for c in columns], F.col("doc_id").cast("long").cast("string").alias("__doc"))
    groups = docs.count() // GROUP_DOCS + 1
    buckets = buckets or groups // 2 + 8

    narrow = rows.select("__doc", F.col("text").cast("string").alias("text"))
    hits = narrow.mapInPandas(_triples(buckets, groups), "bucket long, blob binary").groupBy("bucket").applyInPandas(
        _lean(_shared(groups, hot_docs)), "grp long, blob binary").checkpoint()
    release_shuffles(spark)
    # More than hot_docs documents share each: at most (sampled places / hot_docs) of them.
    hot = np.concatenate([np.zeros(0, np.int64)] + [_table(r[0], 1)[0] for r in hits.where("grp = -1").select("blob").toLocalIterator()])

    @F.pandas_udf("long")
    def group_of(ids: pd.Series) -> pd.Series:
        return pd.Series(_group(np.array([_NULL if pd.isna(d) else int(d) for d in ids.tolist()], dtype=np.int64), groups))

    grouped = rows.withColumn("__grp", group_of("__doc"))
    contexts = grouped.groupBy("__grp").cogroup(hits.where("grp >= 0").groupBy("grp")).applyInPandas(
        _lean_pair(_contexts(buckets, groups, hot)), "bucket long, rows binary, bytes binary")
    ranges = contexts.groupBy("bucket").applyInPandas(_lean(_sorted(groups)), "grp long, blob binary")
    schema = T.StructType([f for f in rows.select(*[F.col(f"`{c}`") for c in columns]).schema.fields] + [
        T.StructField("kept", T.BinaryType()), T.StructField("span_starts", T.ArrayType(T.LongType())), T.StructField("span_ends", T.ArrayType(T.LongType()))])
    cut = grouped.groupBy("__grp").cogroup(ranges.groupBy("grp")).applyInPandas(_lean_pair(_cut(columns)), schema)
    return cut.select(*[F.col(f"`{f.name}`").cast(whole[f.name]).alias(f.name) if f.name in whole else F.col(f"`{f.name}`") for f in schema.fields])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings cut from their texts; a character cut in two goes whole."""

    @F.pandas_udf("string")
    def text(kept: pd.Series) -> pd.Series:
        return pd.Series([k.decode("utf-8", "ignore") for k in kept.tolist()], dtype=object)

    # Own columns with the names of results give way while the operator works.
    own = {c: f"__own_{c}" for c in docs.columns if c in ("kept", "span_starts", "span_ends")}
    rows = remove_repeats(docs.withColumnsRenamed(own))
    rows = rows.withColumn("text", F.when(F.size("span_starts") > 0, text("kept")).otherwise(F.col("text")))
    return rows.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
