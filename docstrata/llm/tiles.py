"""What the tiled pair comparisons share: links of a tile, told as counts and a thin forest."""

from __future__ import annotations

import numpy as np


def union_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for n nodes and links (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def tile_result(ids: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, root) of each node that has a link: never a row for each link.

    ids are distinct; weight is how many rows a node stands for; root is the smallest id
    of its component in the tile.
    """
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    roots = order[union_labels(len(ids), rank[a], rank[b])][rank]
    some = np.flatnonzero(links)
    return ids[some], links[some], ids[roots[some]]
