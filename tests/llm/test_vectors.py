import numpy as np
import pytest

from quarry.llm import vectors as v
from quarry.plans import skew

SCHEMA = "id BIGINT, label INT, features ARRAY<DOUBLE>, split STRING, source STRING, vec STRING, cell INT, key STRING, d2 INT"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "k", 2) for r in rows], SCHEMA)


def brute(rows, ids, k):
    x = {r[0]: np.array(r[2]) for r in rows}
    return {q: [i for _, i in sorted((float(((x[q] - y) ** 2).sum()), i) for i, y in x.items() if i != q)[:k]] for q in ids}


def clusters(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (n // 10, dim))
    return [(i, i % 3, (centres[i % len(centres)] + rng.normal(0, 1, dim)).round(3).tolist(), ("train", "valid", "test")[i % 3], f"s{i % 2}") for i in range(n)]


def dirty(dim):
    return [
        (900, 1, None, "train", "s"), (901, 1, [1.0] * (dim - 1), "train", "s"), (902, 1, [float("nan")] * dim, "test", None),
        (903, 1, [0.0] * dim, "test", "s"), (904, None, [None] + [1.0] * (dim - 1), None, None), (None, 1, [1.0] * dim, "train", "s"),
    ]


def test_recall_and_order(spark):
    rows = clusters(600, 12)
    got = v.similar_vectors(table(spark, rows + dirty(12) + rows[:50]), k=5, dim=12, per_cell=60).collect()
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append(r["id"])
    want = brute(rows, [r[0] for r in rows], 5)
    assert set(mine) == set(want) and all(len(m) == 5 for m in mine.values())
    hit = sum(len(set(mine[q]) & set(want[q])) for q in want)
    assert hit >= 0.98 * 5 * len(want)
    assert {r["label"] for r in got if r["id"] == 7} == {7 % 3}


@pytest.mark.parametrize("hot", [5, 50_000])
def test_copies_and_ties(spark, monkeypatch, hot):
    """A third of all rows are copies of one vector; ties go to the smaller id."""
    monkeypatch.setattr(skew, "HOT", hot)
    rows = clusters(60, 6) + [(100 + i, 1, [5.0] * 6, "train", "s") for i in range(40)]
    queries = spark.createDataFrame([(100,), (139,), (3,), (None,), (5555,), (3,)], "query_id BIGINT")
    got = v.similar_vectors(table(spark, rows), queries, k=10, dim=6).collect()
    mine = {q: [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert mine == brute(rows, [100, 139, 3], 10)
    assert mine[139] == list(range(100, 110))


def test_few_rows_and_empty(spark):
    rows = clusters(20, 4)[:3]
    assert v.similar_vectors(table(spark, rows), dim=4).count() == 6
    assert v.similar_vectors(table(spark, []), dim=4).count() == 0
    t = v.cross_split_matches(table(spark, []), dim=4)
    assert v.match_pairs(*t).count() == 0 and v.match_counts(*t).count() == 0


def test_chi_square():
    assert v.chi2_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    with pytest.raises(ValueError):
        v.chi2_quantile(0.9, 7)


def test_cells_cover_space():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    cells = v.Cells(np.eye(6)[:, :4], x[:100], 4)
    p = x @ cells.basis
    at, b = cells.of(p), cells.bounds(p)
    assert (b[np.arange(500), at] == 0).all()
    for i in range(0, 500, 50):  # the bound never exceeds a true distance
        d = ((p - p[i]) ** 2).sum(1)
        assert (b[i, at] <= d + 1e-9).all()


def cross(rows, ratio):
    out = set()
    for a in rows:
        for b in rows:
            if a[3] == "train" and b[3] in ("valid", "test"):
                x, y = np.array(a[2]), np.array(b[2])
                if ratio * ((x - y) ** 2).sum() <= max((x * x).sum(), (y * y).sum()):
                    out.add((a[0], b[0]))
    return out


def test_cross_split(spark):
    rng = np.random.default_rng(3)
    rows = clusters(240, 8, 5)
    for i in range(60):  # near copies at about the limit, and exact ones
        base = rows[int(rng.integers(0, 240))]
        noise = rng.normal(size=8)
        noise *= rng.uniform(0.5, 1.5) * np.linalg.norm(base[2]) / 20 / np.linalg.norm(noise)
        rows.append((300 + i, 0, (np.array(base[2]) + noise * (i % 4 > 0)).tolist(), ("train", "valid", "test")[i % 3], None if i % 5 else "s9"))
    t = v.cross_split_matches(table(spark, rows + dirty(8) + rows[-5:]), dim=8, per_cell=20)
    got = v.match_pairs(*t).collect()
    want = cross(rows, 400)
    assert {(r["train_id"], r["held_out_id"]) for r in got} == want and len(got) == len(want) > 10
    counts = v.match_counts(*t).collect()
    assert sum(r["n_pairs"] for r in counts) == len(want)
    assert sum(r["n_overlapping"] for r in counts) == len({b for _, b in want})
    assert sum(r["n_rows"] for r in counts) == sum(r[3] != "train" for r in rows)


@pytest.mark.parametrize(("hot", "run", "suffixes"), [(64, 65_536, 2_000_000), (2, 65_536, 300), (10**6, 3, 2_000_000)])
def test_suffix_array(spark, monkeypatch, hot, run, suffixes):
    """Forty-nine values at three scales, near copies up to the limit: all found, also where spans
    are so common that the rows are searched by radius."""
    monkeypatch.setattr(v, "HOT_SPAN", hot)
    monkeypatch.setattr(v, "RUN", run)
    monkeypatch.setattr(v, "SUFFIXES", suffixes)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(90):
        base = rng.normal(100, 40, 49) * (1e-6, 1.0, -1e9)[i % 3]
        for j in range(3):
            noise = rng.normal(size=49)
            noise *= rng.uniform(0.0, 1.3) * np.linalg.norm(base) / 20 / np.linalg.norm(noise) * (j > 0)
            rows.append((1000 * i + j, 0, (base + noise).tolist(), ("train", "test", "valid")[(i + j) % 3], "s"))
    got = v.match_pairs(*v.cross_split_matches(table(spark, rows + dirty(49)), dim=49)).collect()
    want = cross(rows, 400)
    assert {(r["train_id"], r["held_out_id"]) for r in got} == want and len(got) == len(want) > 60


def test_suffix_words_sort_as_suffixes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 49))
    row, level = v._leveled(x, 0.05, False)
    words = v._suffix_keys(x, level, 400.0)
    unit = v._layout(49, 400.0)[0]
    letters = np.floor(x / (unit * v.LEVEL ** level)[:, None])
    same = level == level[0]
    for i, s in enumerate(v._layout(49, 400.0)[4][:5]):
        order = sorted(np.flatnonzero(same), key=lambda r: tuple(letters[r, s : s + v.SPAN]))
        assert (np.diff(words[order, i].astype(object)) >= 0).all()


@pytest.mark.parametrize("hot", [5, 50_000])
def test_cross_split_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT", hot)
    rows = [(i, 1, [1.0, 2.0], "train" if i < 30 else "test", "s") for i in range(60)]
    t = v.cross_split_matches(table(spark, rows), dim=2)
    assert v.match_pairs(*t).count() == 900
    assert v.match_counts(*t).first()["n_pairs"] == 900
