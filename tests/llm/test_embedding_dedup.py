import numpy as np

from proseaudit.llm import embedding_dedup, queries
from proseaudit.llm.small_world import Graph


def brute(rows):
    ok = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, parent = {}, {}
    for kind in {(x[2], len(x[1])) for x in ok}:
        own = [x for x in ok if (x[2], len(x[1])) == kind]
        m = np.array([x[1] for x in own], float)
        m /= np.abs(m).max(1)[:, None]
        m /= np.linalg.norm(m, axis=1)[:, None]
        near = m @ m.T >= 0.93
        np.fill_diagonal(near, False)
        root = embedding_dedup.roots(len(own), *np.nonzero(near))
        least = {}
        for (i, _, _), r in zip(own, root):
            least[r] = min(least.get(r, i), i)
        for (i, _, _), n, r in zip(own, near.sum(1), root):
            links[i], parent[i] = int(n), least[r]
    return {i: (links.get(i, 0), parent.get(i, i)) for i, _, _ in rows}


def test_graph_recall():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 32)) for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Graph.load(x, Graph(x).dump())
    ids, _ = graph.search(x[:300], 48)
    truth = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, truth)]) > 0.97


def test_brute(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in rng.normal(size=(150, 16)):
        for _ in range(int(rng.integers(1, 6))):
            rows.append((c + 0.15 * rng.normal(size=16)).tolist())
    hot = rng.normal(size=16)
    rows += [(hot + 0.05 * rng.normal(size=16)).tolist() for _ in range(200)] + [hot.tolist()] * 100 + [[1e200] * 16, [1e200] * 16, [1e-200] * 16]
    data = [(i, v, i % 2 if i % 7 else None) for i, v in enumerate(rows)]
    n = len(data)
    data += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [1.0, None] * 8, 0), (n + 4, [], 0), (n + 5, [1.0] * 3, 0), (n + 6, [1.0] * 3, 0), (n + 7, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS node", "'x' AS size").repartition(3)
    got = embedding_dedup.dedup(df, shard=128, beam=16, recall=1.0).collect()
    want = brute(data)
    assert len(got) == len(data)
    wrong = [r.vec_id for r in got if (r.n_links, r.component_id) != want[r.vec_id]]
    assert len(wrong) <= 0.02 * len(data), wrong  # beams may miss a few links; counts never exceed the truth
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_query_recall(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op4(spark, folder).collect()}
    assert set(got) == set(want) and sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, None, 0), (None, [1.0, 0.0], 0)], "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.kept) for r in embedding_dedup.dedup(df).collect())
    assert got == [(-1, 0, True), (1, 0, True), (1, 1, True), (1, 1, True)]


class Blind:
    """A graph in which a search meets the node at the query's own place and no other, until its beam is ``wide``."""

    def __init__(self, x, wide):
        self.x, self.wide = x, wide

    def search(self, queries, beam):
        sims = queries @ self.x.T
        if beam < self.wide:
            sims = np.where(sims > 0.9999999, sims, -np.inf)
        ids = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        sims = np.take_along_axis(sims, ids, 1)
        return np.where(sims > -np.inf, ids, -1), sims


def test_audit_sees_rare_links():
    """One near pair among 1,000 vectors, in a shard with itself and between two shards, and many of them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 64))
    x[501] = x[300] + 0.01 * rng.normal(size=64)
    y = rng.normal(size=(1000, 64))
    y[7] = x[123] + 0.01 * rng.normal(size=64)
    many = np.concatenate([x[:500], x[:500] + 0.01 * rng.normal(size=(500, 64))])
    x, y, many = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y, many))
    assert np.argwhere(embedding_dedup.found(Blind(y, 256), x, y, 0.93, 16, 0.98)).tolist() == [[123, 7]]
    own = embedding_dedup.found(Blind(x, 256), x, x, 0.93, 16, 0.98, own=True)
    np.fill_diagonal(own, False)
    assert np.argwhere(own).tolist() == [[300, 501], [501, 300]]
    own = embedding_dedup.found(Blind(many, 256), many, many, 0.93, 16, 0.98, own=True)
    np.fill_diagonal(own, False)
    assert (own == (embedding_dedup.exact(many, many, 0.93) & ~np.eye(1000, dtype=bool))).all()


def test_links_come_from_the_graph(monkeypatch):
    """A full shard with few links: every query goes through the graph, and little is compared whole."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4096, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[-150:] = embedding_dedup.plant(x[:150], 0.93, rng)
    graph, compared, searched = Graph(x), [], []
    plain, search = embedding_dedup.exact, Graph.search
    monkeypatch.setattr(embedding_dedup, "exact", lambda a, b, t: compared.append(len(a) * len(b)) or plain(a, b, t))
    monkeypatch.setattr(Graph, "search", lambda self, q, beam: searched.append(len(q)) or search(self, q, beam))
    got = embedding_dedup.found(graph, x, x, 0.93, 64, 0.98, own=True)
    want = plain(x, x, 0.93)
    np.fill_diagonal(got, False)
    np.fill_diagonal(want, False)
    assert want.sum() >= 300 and (got & want).sum() >= 0.98 * want.sum() and not (got & ~want).any()
    assert sum(compared) < 0.1 * len(x) ** 2 and len(x) in searched


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[-200:] = embedding_dedup.plant(x[:200], 0.93, rng)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(8)).collect()}
    want = {i: n for i, (n, _) in brute(rows).items()}
    assert sum(want.values()) >= 400 and sum(got.values()) >= 0.98 * sum(want.values())
    assert len(got) == len(want) and all(got[i] <= n for i, n in want.items())
