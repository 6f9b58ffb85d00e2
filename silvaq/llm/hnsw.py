"""A hierarchical navigable small-world graph over unit vectors, in numpy. Points are inserted and queries answered in batches."""

from __future__ import annotations

import numpy as np

_LOW = np.float32(-np.inf)


class Graph:
    """x: unit rows (float32). m: neighbours above the ground layer; the ground layer has twice as many. Levels follow a fixed seed."""

    def __init__(self, x: np.ndarray, *, m: int = 12, beam: int = 48, batch: int = 256, seed: int = 5):
        self.x, self.m, self.beam = np.ascontiguousarray(x, np.float32), m, beam
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(m)).astype(int)
        order = rng.permutation(n)
        top = int(level.max()) if n else 0
        if n:  # the entry is on every layer
            level[order[0]] = top
            self.entry = int(order[0])
        self.links = [np.full((n, m if layer else 2 * m), -1, np.int32) for layer in range(top + 1)]
        at = 1
        while at < n:
            size = min(batch, at, n - at)
            self._insert(order[at : at + size], level)
            at += size

    def arrays(self) -> dict[str, np.ndarray]:
        """What a graph is made of, for saving; from_arrays() makes it again."""
        return {"x": self.x, "entry": np.array([self.entry if len(self.x) else -1])} | {f"layer{i}": a for i, a in enumerate(self.links)}

    @classmethod
    def from_arrays(cls, arrays: dict[str, np.ndarray]) -> Graph:
        out = cls.__new__(cls)
        out.x, out.entry, out.links = arrays["x"], int(arrays["entry"][0]), []
        while (layer := arrays.get(f"layer{len(out.links)}")) is not None:
            out.links.append(layer)
        return out

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        near = np.full((len(new), 1), self.entry, np.int32)
        for layer in range(len(self.links) - 1, -1, -1):
            here = level[new] >= layer
            ids, sims = self.search_layer(self.x[new], near, self.beam if here.any() else 1, layer)
            if here.any():
                points = new[here]
                # Points of one batch are candidates for each other too.
                mutual = self.x[points] @ self.x[points].T
                np.fill_diagonal(mutual, _LOW)
                ids_here = np.hstack([ids[here], np.broadcast_to(points.astype(np.int32), mutual.shape)])
                sims_here = np.hstack([sims[here], mutual])
                keep = min(ids_here.shape[1], self.beam)
                best = np.argpartition(-sims_here, keep - 1, axis=1)[:, :keep]
                chosen = self._select(points, np.take_along_axis(ids_here, best, 1), np.take_along_axis(sims_here, best, 1), self.m)
                self.links[layer][points, : self.m] = chosen
                self._link_back(points, chosen, layer)
            near = ids[:, : max(1, min(4, ids.shape[1]))]

    def _select(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` neighbours of each point: the nearest ones that are nearer to it than to those chosen before, then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        b, c = ids.shape
        v = self.x[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", v, v, optimize=True)
        closest = np.full((b, c), _LOW)
        taken, counts = np.zeros((b, c), bool), np.zeros(b, int)
        for j in range(c):
            take = (ids[:, j] >= 0) & (sims[:, j] > _LOW) & (closest[:, j] < sims[:, j]) & (counts < most)
            taken[take, j] = True
            counts += take
            closest[take] = np.maximum(closest[take], between[take, j])
        rank = np.where((ids >= 0) & (sims > _LOW), np.where(taken, 0, 1), 2)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, points: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        links = self.links[layer]
        cap = links.shape[1]
        a, k = np.nonzero(chosen >= 0)
        source, target = points[a], chosen[a, k]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hubs, first, counts = np.unique(target, return_index=True, return_counts=True)
        used = (links[hubs] >= 0).sum(1)
        width = int((used + counts).max()) if len(hubs) else 0
        fits = used + counts <= cap
        slot = np.arange(len(target)) - np.repeat(first, counts)
        of = np.repeat(np.arange(len(hubs)), counts)
        ok = fits[of]
        links[target[ok], used[of[ok]] + slot[ok]] = source[ok]
        full = np.flatnonzero(~fits)
        for at in range(0, len(full), 256):
            part = full[at : at + 256]
            width = int((used[part] + counts[part]).max())
            pool = np.full((len(part), width), -1, np.int32)
            pool[:, :cap] = links[hubs[part]][:, : min(cap, width)]
            for row, h in enumerate(part):
                pool[row, used[h] : used[h] + counts[h]] = source[first[h] : first[h] + counts[h]]
            sims = np.einsum("bcd,bd->bc", self.x[np.maximum(pool, 0)], self.x[hubs[part]])
            sims[pool < 0] = _LOW
            if width > 4 * cap:
                best = np.argpartition(-sims, 4 * cap, axis=1)[:, : 4 * cap]
                pool, sims = np.take_along_axis(pool, best, 1), np.take_along_axis(sims, best, 1)
            links[hubs[part]] = self._select(hubs[part], pool, sims, cap)

    def search_layer(self, q: np.ndarray, near: np.ndarray, beam: int, layer: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of a beam search from the points `near`; -1 where a beam is not full. Each step opens `wide` points of each query."""
        x, links, n = self.x, self.links[layer], len(q)
        rows = np.arange(n)
        seen = np.zeros((n, len(x)), bool)
        seen[rows[:, None], np.maximum(near, 0)] = True
        ids = np.full((n, max(beam, near.shape[1])), -1, np.int32)
        sims = np.full(ids.shape, _LOW)
        ids[:, : near.shape[1]] = near
        sims[:, : near.shape[1]] = np.where(near >= 0, np.einsum("bcd,bd->bc", x[np.maximum(near, 0)], q), _LOW)
        beam = ids.shape[1]
        wide = min(wide, beam)
        open_ = ids >= 0
        live = rows
        while len(live):
            s = np.where(open_[live], sims[live], _LOW)
            best = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            value = np.take_along_axis(s, best, 1)
            worst = sims[live].min(1)
            go = (value > _LOW) & (value >= worst[:, None])
            alive = go.any(1)
            live, best, go = live[alive], best[alive], go[alive]
            if not len(live):
                break
            open_[live[:, None], best] &= ~go
            nb = links[np.where(go, ids[live[:, None], best], 0)]
            nb = np.where(go[:, :, None], nb, -1).reshape(len(live), -1)
            nb.sort(1)
            fresh = nb >= 0
            fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            fresh &= ~seen[live[:, None], np.maximum(nb, 0)]
            a, k = np.nonzero(fresh)
            found = nb[a, k]
            seen[live[a], found] = True
            new = np.full(nb.shape, _LOW)
            new[a, k] = np.einsum("ed,ed->e", x[found], q[live[a]])
            all_ids, all_sims = np.hstack([ids[live], nb]), np.hstack([sims[live], new])
            all_open = np.hstack([open_[live], fresh])
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            kept = np.take_along_axis(all_sims, keep, 1)
            sims[live] = kept
            ids[live] = np.where(kept > _LOW, np.take_along_axis(all_ids, keep, 1), -1)
            open_[live] = np.take_along_axis(all_open, keep, 1) & (kept > _LOW)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam on the ground layer, in no order."""
        near = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.links) - 1, 0, -1):
            ids, sims = self.search_layer(q, near, 4, layer, 1)
            near = ids
        return self.search_layer(q, near, beam, 0)

    def within(self, q: np.ndarray, least: float, beam: int, margin: float = 0.04) -> list[np.ndarray]:
        """Points of similarity `least` or more that a search finds: the beam, widened over neighbours of all that come within `margin` of it."""
        ids, sims = self.search(q, beam)
        out = []
        for row in range(len(q)):
            close = sims[row] >= least - margin
            reached = ids[row][close]
            hits = [ids[row][sims[row] >= least]]
            if len(reached):
                seen = np.zeros(len(self.x), bool)
                seen[reached] = True
                front = reached
                while len(front):
                    nb = self.links[0][front].ravel()
                    nb = np.unique(nb[nb >= 0])
                    nb = nb[~seen[nb]]
                    seen[nb] = True
                    s = self.x[nb] @ q[row]
                    front = nb[s >= least - margin]
                    hits.append(nb[s >= least])
            out.append(np.concatenate(hits))
        return out
