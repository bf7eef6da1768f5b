"""Evaluation passages inside a corpus: suffix arrays over corpus shards.

The corpus is cut into shards of whole documents. A shard's words become one sequence of word
codes (63-bit hashes, so the order of a shard does not depend on the items), and all its suffixes
are sorted to the passage length at least: its suffix array. Every suffix of every item is then
binary-searched in it. Between the two bounds lie all places that hold its first words verbatim;
they are extended to their longest length.

Items are searched in groups of at most ``GROUP_WORDS`` words, ``AT_ONCE`` groups a pass. A pass reads
the corpus once, sorts each shard once and searches all its groups there; its groups are released
before the next pass. None of these bounds grows with the data; more items mean more passes.

Words are maximal runs of Unicode letters or digits, lower-cased. An item shorter than the
passage length matches as a whole. Null, empty and wordless texts and items match nothing;
repeated ids give one row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import materialize

WORD = re.compile(r"[^\W_]+")
SHARD_WORDS = 1_000_000
GROUP_WORDS = 500_000
AT_ONCE = 4
KNOWN = 1_000_000  # distinct words whose codes a task remembers


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def code_of(word: str) -> int:
    """63 bits of a hash; never the code that ends a document, which is -1."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def probes_of(ids: list[int], lists: list[list[str]], length: int) -> tuple[np.ndarray, ...]:
    """A group of items for searching: (ids, codes, item, place in the codes, span) with one entry of
    the last three for every suffix of at least a passage, or for the whole of a shorter item."""
    codes = np.array([code_of(w) for ws in lists for w in ws], np.int64)
    ends = np.cumsum([len(ws) for ws in lists])
    at, item, span = [], [], []
    for i, (ws, e) in enumerate(zip(lists, ends.tolist())):
        n = len(ws)
        k = max(1, n - length + 1) if n else 0
        at.append(np.arange(e - n, e - n + k))
        item.append(np.full(k, i))
        span.append(np.full(k, min(n, length)))
    return np.array(ids, np.int64), codes, *(np.concatenate(x) if x else np.empty(0, int) for x in (item, at, span))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` words or more.

    Ranks by one word come first; then as many ranks as a 64-bit word holds make the ranks by that
    many times more words, until the depth is reached."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1  # 0: behind the end
    known = 1
    while known < depth:
        bits = int(rank.max(initial=1)).bit_length()
        times = max(2, min(62 // bits, -(-depth // known)))
        key = np.zeros(n, np.int64)
        for j in range(times):
            part = np.zeros(n, np.int64)
            part[: max(n - j * known, 0)] = rank[j * known :]
            key = (key << bits) | part
        known *= times
        if known >= depth:
            return np.argsort(key, kind="stable")
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    return np.argsort(rank, kind="stable")


def _bounds(codes: np.ndarray, order: np.ndarray, probe: np.ndarray, at: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last place in the suffix array of the suffixes that begin with each probe's
    words: all probes are searched at once, word by word where the first ones are equal."""
    got = []
    for upper in (False, True):
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) >> 1
            pos, want, left = order[mid], at[live], span[live]
            sign = np.zeros(len(live), np.int64)  # of the suffix against the probe
            same = np.arange(len(live))
            for j in range(int(span.max())):
                same = same[left[same] > j]
                if not len(same):
                    break
                place = pos[same] + j
                a = np.where(place < len(codes), codes[np.minimum(place, len(codes) - 1)], -2)
                b = probe[want[same] + j]
                sign[same] = np.where(a < b, -1, np.where(a > b, 1, 0))
                same = same[a == b]
            right = sign < 0 if not upper else sign <= 0
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
        got.append(lo)
    return got[0], got[1]


def search_shard(codes: np.ndarray, order: np.ndarray, bounds: np.ndarray, group: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, item number, word position in the document, matched words) of one group of
    items in a shard: ``codes`` holds its documents, each followed by -1, ``bounds`` their starts."""
    _, probe, items, at, span = group
    if not len(at) or not len(codes):
        return (np.empty(0, int),) * 4
    lo, hi = _bounds(codes, order, probe, at, span)
    n = hi - lo
    if not n.sum():
        return (np.empty(0, int),) * 4
    pos = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    which = np.repeat(np.arange(len(at)), n)
    doc, item, span, diagonal = np.searchsorted(bounds, pos, "right") - 1, items[which], span[which], pos - at[which]
    pos = pos - bounds[doc]
    # windows on one diagonal that follow each other are one passage, extended to its full length
    o = np.lexsort((pos, diagonal, item, doc))
    doc, item, pos, span, diagonal = doc[o], item[o], pos[o], span[o], diagonal[o]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(pos) != 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], item[first], pos[first], pos[last] - pos[first] + span[last]


def passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", length: int = 10) -> DataFrame:
    """(doc_id, item_id, doc_pos, n_words): every passage of an item found verbatim in a document,
    at its longest, with its word position in the document (from 0)."""
    spark = docs.sparkSession
    asked = items.where(F.col(item_id).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).distinct()
    corpus = docs.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).cast("string").alias("t"))
    schema = "doc_id BIGINT, item_id BIGINT, doc_pos BIGINT, n_words BIGINT"
    found = None
    for groups in _passes(asked.toLocalIterator(), length):
        shared = spark.sparkContext.broadcast(groups)  # plain arrays travel, not a class executors may lack
        part = materialize(corpus.mapInPandas(_searcher(shared, length), schema), "passages")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _passes(rows: Iterator, length: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """The groups of each pass; only those of one pass are held."""
    groups, ids, lists, held = [], [], [], 0
    for r in rows:
        ws = words(r["t"])
        if held and held + len(ws) > GROUP_WORDS:
            groups.append(probes_of(ids, lists, length))
            ids, lists, held = [], [], 0
            if len(groups) == AT_ONCE:
                yield groups
                groups = []
        ids.append(r["i"])
        lists.append(ws)
        held += len(ws)
    if held:
        groups.append(probes_of(ids, lists, length))
    if groups:
        yield groups


def _searcher(shared, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = shared.value
        ids, codes, starts, held = [], [], [], 0
        known: dict[str, int] = {}

        def flush() -> pd.DataFrame:
            shard, at, names = np.concatenate(codes), np.array(starts), np.array(ids)
            order = suffix_array(shard, length)
            parts = []
            for g in groups:
                doc, item, pos, n = search_shard(shard, order, at, g)
                parts.append(pd.DataFrame({"doc_id": names[doc], "item_id": g[0][item], "doc_pos": pos, "n_words": n}, dtype="int64"))
            return pd.concat(parts)

        for b in batches:
            for d, t in zip(b["d"], b["t"]):
                ws = words(t)
                if len(known) > KNOWN:
                    known.clear()
                for w in set(ws).difference(known):
                    known[w] = code_of(w)
                # -1 ends a document: no item has it, so no passage crosses it
                ids.append(d)
                starts.append(held)
                codes.append(np.array([*map(known.__getitem__, ws), -1], np.int64))
                held += len(ws) + 1
                if held >= SHARD_WORDS:
                    yield flush()
                    ids, codes, starts, held = [], [], [], 0
        if held:
            yield flush()

    return run


def leaked_documents(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """(doc_id, item_id): the documents that hold a passage, with the items that leaked."""
    return passages(docs, items, **kw).select("doc_id", "item_id").distinct()


def remove_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **kw) -> DataFrame:
    """The documents that hold no passage of any item, all columns as they came."""
    bad = leaked_documents(docs, items, doc_id=doc_id, **kw).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(bad, docs[doc_id].cast("bigint") == bad["_leaked"], "left_anti")
