"""A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors at a time.

Every node has a level drawn from its number; layer l holds the nodes of level l or more. Layers are built from the top. A batch of
nodes is searched for in what stands of its layer, starting from where the layers above lead, compared with each other, and linked to
neighbours that are closer to the node than to the neighbours already chosen, so that clusters stay connected.
"""

from __future__ import annotations

import pickle

import numpy as np

WIDTH, BATCH = 24, 1024


class Graph:
    def __init__(self, vectors: np.ndarray, beam: int = 48):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        draw = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / (1 << 53)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(WIDTH / 2)).astype(int)
        self.layers: list[np.ndarray] = []  # neighbours by node, -1 where there is none; the top layer first
        for at in range(int(level.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(level >= at)
            above = np.flatnonzero(level[nodes] > at)
            self._build(nodes[np.argsort(-level[nodes], kind="stable")], beam, max(1, len(above)))
        self.entry = int(np.argmax(level)) if n else 0

    def _build(self, nodes: np.ndarray, beam: int, start: int) -> None:
        links = np.full((len(self.x), WIDTH), -1, np.int32)
        self.entry = int(nodes[0])
        self.layers.append(links)
        done = 0
        while done < len(nodes):
            size = min(len(nodes) - done, max(64, start, done // 2), BATCH)
            new = nodes[done: done + size]
            among = self.x[new] @ self.x[new].T
            np.fill_diagonal(among, -np.inf)
            top = min(beam, size - 1)
            best = np.argpartition(-among, top - 1, axis=1)[:, :top] if top > 0 else np.empty((size, 0), int)
            ids, sims = new[best], np.take_along_axis(among, best, 1)
            if done:
                found, near = self.search(self.x[new], beam)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, near], 1)
            links[new] = self._choose(new, ids, sims)
            self._back(links, new)
            done += size

    def _choose(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """For each node up to WIDTH of its candidates: in order of similarity, those closer to it than to the ones taken; then the rest."""
        sims = np.where(ids >= 0, sims, -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * WIDTH]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(nodes), WIDTH), -1, np.int32)
        count, taken = np.zeros(len(nodes), int), np.zeros(ids.shape, bool)
        chosen = np.zeros((len(nodes), WIDTH, self.x.shape[1]), np.float32)
        rows = np.arange(len(nodes))
        for varied in (True, False):
            for c in range(ids.shape[1]):
                on = (sims[:, c] > -np.inf) & ~taken[:, c] & (count < WIDTH)
                if varied:
                    to = np.einsum("nd,nwd->nw", self.x[ids[:, c]], chosen)
                    to[np.arange(WIDTH)[None, :] >= count[:, None]] = -np.inf
                    on &= to.max(1) < sims[:, c]
                at = rows[on]
                out[at, count[at]] = ids[at, c]
                chosen[at, count[at]] = self.x[ids[at, c]]
                taken[at, c] = True
                count[at] += 1
        return out

    def _back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Link back from the neighbours of new nodes; a full list is chosen anew."""
        source = np.repeat(new, WIDTH)
        target = links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        known = (links[target] == source[:, None]).any(1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), BATCH):
            part, begin, size = nodes[lo: lo + BATCH], first[lo: lo + BATCH], n[lo: lo + BATCH]
            more = np.full((len(part), int(size.max())), -1, np.int64)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            more[np.repeat(np.arange(len(part)), size), place] = source[np.repeat(begin, size) + place]
            ids = np.concatenate([links[part], more], 1)
            sims = np.einsum("nd,nwd->nw", self.x[part], self.x[np.maximum(ids, 0)])
            links[part] = self._choose(part, ids, sims)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes that the search meets, -1 where there are fewer, and their similarities."""
        ids, sims = np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), -np.inf, np.float32)
        for lo in range(0, len(queries), BATCH):
            q = queries[lo: lo + BATCH].astype(np.float32)
            at = np.full((len(q), 1), self.entry)
            for links in self.layers[:-1]:
                at = self._walk(q, at, links, 4)[0][:, :1]
            ids[lo: lo + BATCH], sims[lo: lo + BATCH] = self._walk(q, at, self.layers[-1], beam)
        return ids, sims

    def _walk(self, q: np.ndarray, start: np.ndarray, links: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        ids, sims, open_ = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32), np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start[:, 0], np.einsum("nd,nd->n", q, self.x[start[:, 0]]), True
        seen = np.zeros((n, len(self.x)), bool)
        seen[np.arange(n), start[:, 0]] = True
        active = np.arange(n)
        step = min(step, beam)
        while len(active):
            rank = np.argsort(~open_[active], axis=1, kind="stable")[:, :step]  # beams are in order of similarity
            use = np.take_along_axis(open_[active], rank, 1)
            node = np.take_along_axis(ids[active], rank, 1)
            open_[active[:, None], rank] = False
            near = np.where(use[:, :, None], links[np.maximum(node, 0)], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[active[:, None], np.maximum(near, 0)]
            row, col = np.nonzero(fresh)
            seen[active[row], near[row, col]] = True
            new = np.full(near.shape, -np.inf, np.float32)
            new[row, col] = np.einsum("nd,nd->n", q[active[row]], self.x[near[row, col]])
            all_sims = np.concatenate([sims[active], new], 1)
            keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), keep, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], 1), keep, 1)
            active = active[open_[active].any(1)]
        ids[sims == -np.inf] = -1
        return ids, sims

    def dump(self) -> bytes:
        return pickle.dumps((self.layers, self.entry))

    @classmethod
    def load(cls, vectors: np.ndarray, data: bytes) -> Graph:
        out = cls.__new__(cls)
        out.x = np.ascontiguousarray(vectors, np.float32)
        out.layers, out.entry = pickle.loads(data)
        return out
