"""Minimum-cut labelling of nodes in a row: terminal capacities and smoothness edges in, one of two labels each out.

Nodes whose terminal capacity outweighs all their edges keep their own side in some
minimum cut, so they are fixed first, their edges become capacities of their
neighbours, and so on; only what is left gets its maximum flow (Dinic), component by
component.  The result is a minimum cut of the whole graph.
"""

from __future__ import annotations

from collections import deque

Edge = tuple[int, int, float]


def max_flow(weights: list[float], links: list[Edge]) -> list[bool]:
    """Minimum cut by Dinic's maximum flow; True: on the source's side.  Positive weights are capacities from the source."""
    n = len(weights)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, w in enumerate(weights):
        link(source, i, w, 0.0) if w > 0 else link(i, sink, -w, 0.0)
    for a, b, w in links:
        link(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def cut(weights: list[float], links: list[Edge]) -> list[bool]:
    """The labels of a minimum cut over all nodes: True where the source's side is."""
    n = len(weights)
    if not links or all(w > 0 for w in weights) or all(w <= 0 for w in weights):
        return [w > 0 for w in weights]
    own = list(weights)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    pull = [0.0] * n  # edges to nodes that are still open
    for a, b, w in links:
        near[a].append((b, w))
        near[b].append((a, w))
        pull[a] += w
        pull[b] += w
    fixed: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(own[i]) >= pull[i]]
    while todo:
        i = todo.pop()
        if fixed[i] is not None:
            continue
        fixed[i] = own[i] > 0
        for j, w in near[i]:
            if fixed[j] is None:
                own[j] += w if fixed[i] else -w
                pull[j] -= w
                if abs(own[j]) >= pull[j] - 1e-12:
                    todo.append(j)
    seen = [False] * n
    for i in range(n):
        if fixed[i] is not None or seen[i]:
            continue
        seen[i] = True
        members = [i]
        for a in members:
            for b, _ in near[a]:
                if fixed[b] is None and not seen[b]:
                    seen[b] = True
                    members.append(b)
        number = {a: k for k, a in enumerate(members)}
        inner = [(number[a], number[b], w) for a in members for b, w in near[a] if a < b and fixed[b] is None]
        for a, side in zip(members, max_flow([own[a] for a in members], inner)):
            fixed[a] = side
    return [bool(x) for x in fixed]
