"""Nested markup records to flat tables that keep parent-child links.

The parser indexes structure before it reads any text: byte bitmaps of ``<``, ``>``
and quotes give the tags, comments are masked, a prefix sum over opening (+1) and
closing (-1) tags gives every tag's depth, and parents and spans follow from the
depths by binary search. Only the spans of wanted elements are then decoded.
All of it is NumPy over a whole Arrow batch; a record whose tags do not balance is
read by a small stack parser instead.

Defined results: a null or empty payload gives no rows; a record counts when its
start tag is followed by its own end tag before another record starts, others are
skipped; comments and declarations are ignored everywhere; a missing attribute is
null; a record without an integer key has a null key; a null file id counts as file -1; extra columns of the input are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "file_key BIGINT, record_no INT, record_key BIGINT, node_no INT, parent_no INT, "
    "tag STRING, parent_tag STRING, depth INT, place INT, entry STRING"
)
_ATTR = re.compile(r"""([A-Za-z_][\w.-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_TAG = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"\s+")
_QUOTE = re.compile(rb"[>\"']")
_KEY = re.compile(r"[0-9]+")


def plain(raw: str) -> str:
    """Text of a span: comments and tags out, references decoded, white space collapsed."""
    if "<" in raw:
        raw = _TAG.sub("", _COMMENT.sub("", raw))
    if "&" in raw:
        raw = html.unescape(raw)
    return _SPACE.sub(" ", raw).strip()


def attributes(tag: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTR.findall(tag)}


def structural_index(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (after ``>``), lower-case name and +1/-1 of each tag outside comments."""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    lt, gt = np.flatnonzero(a == 60), np.flatnonzero(a == 62)
    padded = np.concatenate([a, np.zeros(4, np.uint8)])
    cover = np.zeros(n + 1, np.int32)
    starts = lt[(padded[lt + 1] == 33) & (padded[lt + 2] == 45) & (padded[lt + 3] == 45)]
    if len(starts):
        ends = gt[(gt >= 2) & (a[np.maximum(gt - 1, 0)] == 45) & (a[np.maximum(gt - 2, 0)] == 45)]
        upto = 0
        for s in starts.tolist():
            if s < upto:
                continue
            k = np.searchsorted(ends, s + 6)
            upto = int(ends[k]) + 1 if k < len(ends) else n
            cover[s] += 1
            cover[upto] -= 1
    hidden = np.cumsum(cover[:-1]) > 0
    close = padded[lt + 1] == 47
    first = padded[lt + 1 + close] | 32
    lt, close = (x[(first >= 97) & (first <= 122) & ~hidden[lt]] for x in (lt, close))
    k = np.searchsorted(gt, lt)
    lt, close, k = (x[k < len(gt)] for x in (lt, close, k))
    end = _tag_ends(a, data, lt, gt, k)
    # a name runs to the first byte that cannot be part of one
    part = ((a >= 97) & (a <= 122)) | ((a >= 65) & (a <= 90)) | ((a >= 48) & (a <= 57)) | (a == 45) | (a == 95)
    stop = np.append(np.flatnonzero(~part), n)
    begin = lt + 1 + close
    length = np.minimum(stop[np.searchsorted(stop, begin)], end) - begin
    width = max(int(length.max(initial=0)), 1)
    if len(lt) * width <= 1 << 26:
        at = np.minimum(begin[:, None] + np.arange(width)[None, :], n - 1)
        raw = np.where(np.arange(width)[None, :] < length[:, None], a[at], 0).astype(np.uint8)
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
        names = np.ascontiguousarray(raw).view(f"S{width}").ravel() if len(lt) else np.empty(0, "S1")
    else:  # one name so long that a table of all would be too wide
        names = np.array([data[b : b + m].lower() for b, m in zip(begin.tolist(), length.tolist())], object)
    selfclosed = a[np.maximum(end - 2, 0)] == 47
    step = np.where(close, -1, np.where(selfclosed, 0, 1))
    return lt, end, names, step


def _tag_ends(a: np.ndarray, data: bytes, lt: np.ndarray, gt: np.ndarray, k: np.ndarray) -> np.ndarray:
    """End (after ``>``) of the tags that start at ``lt``, whose next ``>`` is number ``k``.

    A ``>`` inside a quoted value ends nothing, whichever kind the quotes are: of the kinds, the one
    opened first counts, and the other is plain text inside it. Tags whose span to the first ``>``
    holds neither kind in odd number are done; the few others are walked quote by quote. A value
    that is not closed before the next ``<`` of a tag is no quoted value: the tag ends at the ``>``."""
    end = gt[k] + 1
    kinds = [np.concatenate([[0], np.cumsum(a == q)]) for q in (34, 39)]
    counts = [c[end] - c[lt] for c in kinds]
    nxt = np.append(lt[1:], len(a))
    for i in np.flatnonzero((counts[0] > 0) & (counts[1] > 0) | (counts[0] & 1 == 1) | (counts[1] & 1 == 1)).tolist():
        at, limit = int(lt[i]), int(nxt[i])
        while m := _QUOTE.search(data, at, limit):
            if m.group() == b">":
                end[i] = m.end()
                break
            shut = data.find(m.group(), m.end(), limit) if data[int(lt[i]) : m.start()].rstrip()[-1:] == b"=" else m.start()  # a quote opens a value after =
            if shut < 0:
                break
            at = shut + 1
    return end


def record_spans(names: np.ndarray, step: np.ndarray, tag: bytes) -> list[tuple[int, int]]:
    """Tag numbers (first, last) of the records that end before another starts."""
    at = np.flatnonzero((names == tag) & (step != 0))
    s = step[at]
    whole = np.flatnonzero((s[:-1] == 1) & (s[1:] == -1)) if len(at) > 1 else np.empty(0, int)
    return [(int(at[i]), int(at[i + 1])) for i in whole]


def _links(names: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Depth, parent and closing tag of each opening tag of one record; None if unbalanced."""
    n = len(step)
    depth = np.cumsum(step) - (step == 1)  # of the element itself; the record has 0
    if step.sum() != 0 or depth.min() < 0:
        return None
    opens, closes = np.flatnonzero(step >= 0), np.flatnonzero(step == -1)
    parent, shut = np.full(n, -1), np.full(n, -1)
    shut[step == 0] = np.flatnonzero(step == 0)
    for d in range(int(depth.max()) + 1):
        mine = opens[(depth[opens] == d) & (step[opens] == 1)]
        ends = closes[depth[closes] == d]
        if len(mine) != len(ends) or (ends < mine).any() or (names[mine] != names[ends]).any():
            return None
        shut[mine] = ends
        if d:
            above = opens[(depth[opens] == d - 1) & (step[opens] == 1)]
            own = opens[((depth[opens] == d) & (step[opens] == 1))]
            parent[own] = above[np.searchsorted(above, own) - 1]
    # a self-closed element's depth already counts those open around it: its parent is the last of
    # the depth above that was opened before it
    alone = np.flatnonzero(step == 0)
    for d in np.unique(depth[alone]).tolist():
        above = opens[(depth[opens] == d - 1) & (step[opens] == 1)]
        own = alone[depth[alone] == d]
        parent[own] = above[np.searchsorted(above, own) - 1]
    return depth, parent, shut


def _links_by_stack(names: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same where tags are left open or closed twice: a closing tag closes the nearest
    open element of its name and all inside it; one that closes nothing is ignored."""
    n = len(step)
    depth, parent, shut = np.zeros(n, int), np.full(n, -1), np.full(n, -1)
    stack: list[int] = []
    for i in range(n):
        if step[i] >= 0:
            depth[i], parent[i] = len(stack), stack[-1] if stack else -1
            if step[i]:
                stack.append(i)
            else:
                shut[i] = i
        else:
            k = next((k for k in range(len(stack) - 1, -1, -1) if names[stack[k]] == names[i]), None)
            if k is not None:
                for j in stack[k:]:
                    shut[j] = i
                del stack[k:]
    return depth, parent, shut


def parse_payload(text: str, record_tag: str, key_attr: str, attr: str, leaves: frozenset[str]) -> list[tuple]:
    """Rows (record_no, key, node_no, parent_no, tag, parent_tag, depth, place, entry).

    ``place`` counts, from 1, the entry's place among the non-empty ones of its tag under
    one parent; elements that are empty or not in ``leaves`` have none.
    """
    data = text.encode("utf-8", "surrogatepass")
    start, end, names, step = structural_index(data)
    rows: list[tuple] = []
    for no, (i, j) in enumerate(record_spans(names, step, record_tag.encode())):
        nm, st = names[i : j + 1], step[i : j + 1]
        depth, parent, shut = _links(nm, st) or _links_by_stack(nm, st)
        found = attributes(data[start[i] : end[i]].decode("utf-8", "replace"))
        key = found.get(key_attr, "").strip()
        key_value = int(key) if _KEY.fullmatch(key) and int(key) < 1 << 63 else None
        opens = np.flatnonzero(st >= 0)
        number = {int(t): k for k, t in enumerate(opens)}
        seen: dict[tuple[int, str], int] = {}
        for t in opens.tolist():
            tag, up = nm[t].decode(), int(parent[t])
            up_tag = nm[up].decode() if up >= 0 else None
            entry, place = None, None
            if t == 0:
                entry, place = found.get(attr), 0
            elif tag in leaves and shut[t] > t:
                entry = plain(data[end[i + t] : start[i + shut[t]]].decode("utf-8", "replace"))
                if entry:
                    place = seen[(up, tag)] = seen.get((up, tag), 0) + 1
            rows.append((no, key_value, number[t], number.get(up), tag, up_tag, int(depth[t]), place, entry))
    return rows


def nodes(
    df: DataFrame,
    key: str = "file_id",
    payload: str = "payload",
    record_tag: str = "reuters",
    key_attr: str = "newid",
    attr: str = "lewissplit",
    leaves: tuple[str, ...] = ("d", "title", "author", "dateline", "body", "date"),
) -> DataFrame:
    """One linked row per element of every whole record: the table the flat ones come from."""
    wanted = frozenset(leaves)
    whole = {"record_key", "parent_no", "place", "file_key"}
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for k, p in zip(b["k"], b["p"]):
                out += [(k, no, *rest) for no, *rest in parse_payload(p, record_tag, key_attr, attr, wanted)]
            # whole columns with nulls as they are: keys near 2**63 would not survive as doubles
            cols = zip(names, zip(*out) if out else [()] * len(names))
            yield pd.DataFrame({n: pd.array(list(v), "Int64") if n in whole else list(v) for n, v in cols})

    got = df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-1)).alias("k"), F.col(payload).cast("string").alias("p"))
    return got.where(F.length("p") > 0).mapInPandas(run, NODE_SCHEMA)


def first_sendings(linked: DataFrame) -> DataFrame:
    """Keep, of records sent several times under one key, the first by file and place.

    The keys' first places are a partial aggregate, and the join is on file, record and
    key, so a record sent very often makes no hot key."""
    first = (
        linked.where("depth = 0 AND record_key IS NOT NULL")
        .groupBy("record_key")
        .agg(F.min(F.struct("file_key", "record_no")).alias("f"))
        .select("record_key", F.col("f.file_key").alias("file_key"), F.col("f.record_no").alias("record_no"))
    )
    return linked.join(first, ["record_key", "file_key", "record_no"], "left_semi")


def records(linked: DataFrame) -> DataFrame:
    """Flat table of records: key, source place, attribute."""
    return linked.where("depth = 0").select(
        F.col("record_key").alias("newid"), "file_key", "record_no", F.col("entry").alias("lewissplit")
    )


def list_entries(linked: DataFrame, entry_tag: str = "d") -> DataFrame:
    """Flat table of list entries, each with its record's key, its list and its place."""
    listed = (F.col("tag") == entry_tag) & F.col("place").isNotNull() & (F.col("depth") > 1)
    return linked.where(listed).select(
        F.col("record_key").alias("newid"), F.col("parent_tag").alias("tag"), F.col("parent_no"), F.col("place").alias("seq_no"), "entry"
    )


def text_elements(linked: DataFrame, tags: tuple[str, ...] = ("title", "author", "dateline")) -> DataFrame:
    """Flat table of text elements, each with its record's key and place."""
    return linked.where(F.col("tag").isin(*tags) & F.col("place").isNotNull()).select(
        F.col("record_key").alias("newid"), "tag", "parent_no", F.col("place").alias("seq_no"), "entry"
    )


def articles(linked: DataFrame, list_tag: str = "topics", body_tag: str = "body") -> DataFrame:
    """(newid, topics, body): the three fields a text pipeline needs, topics in their order."""
    entry = (F.col("tag") == "d") & (F.col("parent_tag") == list_tag) & F.col("place").isNotNull()
    body = (F.col("tag") == body_tag) & (F.col("place") == 1)
    got = linked.where("record_key IS NOT NULL AND (depth = 0 OR tag = 'd' OR tag = '%s')" % body_tag).groupBy(F.col("record_key").alias("newid"))
    listed = F.array_sort(F.collect_list(F.when(entry, F.struct("place", "entry"))))
    return got.agg(listed.alias("t"), F.max(F.when(body, F.col("entry"))).alias("body")).select("newid", F.transform("t", lambda x: x["entry"]).alias("topics"), "body")


def flat_entries(linked: DataFrame) -> DataFrame:
    """(newid, tag, seq_no, entry) of records, list entries and text elements in one table."""
    cols = ["newid", "tag", "seq_no", "entry"]
    head = records(linked).select("newid", F.lit("reuters").alias("tag"), F.lit(0).alias("seq_no"), F.col("lewissplit").alias("entry"))
    texts = text_elements(linked).where("seq_no = 1")
    return head.unionByName(list_entries(linked).select(cols)).unionByName(texts.select(cols)).where("newid IS NOT NULL")
