"""A tree over boxes for many places at once, in arrays: which boxes can hold the nearest target of a place, or cut its
radius. Targets are boxes without extent."""

from collections.abc import Iterator

import numpy as np

# Slack (degrees) that keeps rounding from deciding a test of boxes; exact tests follow.
SLACK = 1e-9

LEAF = 16


def _hull(boxes: np.ndarray) -> np.ndarray:
    """One box around each group of (groups, boxes, 4)."""
    low, high = boxes[..., :2].min(axis=-2), boxes[..., 2:].max(axis=-2)
    return np.concatenate([low, high], axis=-1)


class BoxTree:
    """Boxes (south, west, north, east), halved at the median of their centres by turns until ``LEAF`` of them are left.

    Halves have equal sizes (the last box is repeated to fill up), so that a level is one array and the children of
    node i are 2 i and 2 i + 1.
    """

    def __init__(self, boxes: np.ndarray):
        depth = max(0, int(np.ceil(np.log2(max(len(boxes), 1) / LEAF))))
        self.size = len(boxes)
        boxes = boxes[np.minimum(np.arange(LEAF << depth), len(boxes) - 1)]
        order, centres = np.arange(len(boxes))[None, :], boxes[:, :2] + boxes[:, 2:]
        self.levels = []
        for level in range(depth):
            by = np.argsort(centres[order, level % 2], axis=1, kind="stable")
            order = np.take_along_axis(order, by, axis=1).reshape(len(order) * 2, -1)
            self.levels.append(_hull(boxes[order]))
        self.items, self.boxes = order, boxes

    def _reach(self, boxes: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest, farthest) distance in degrees from each place to its box."""
        down, left, up, right = boxes[..., 0], boxes[..., 1], boxes[..., 2], boxes[..., 3]
        near = np.hypot(np.maximum(np.maximum(down - lat, lat - up), 0), np.maximum(np.maximum(left - lon, lon - right), 0))
        far = np.hypot(np.maximum(lat - down, up - lat), np.maximum(lon - left, right - lon))
        return near - SLACK, far + SLACK

    def candidates(self, lat: np.ndarray, lon: np.ndarray, radius: float | None = None, step: int = 4096) -> Iterator[tuple]:
        """(place, item, settled) as arrays for each ``step`` of the places.

        Without a radius: the items that can hold the nearest target, ``settled`` being empty. With one: the items that the
        radius may cut, and apart from those the places that have a box wholly inside their radius.
        """
        for begin in range(0, len(lat), step):
            y, x = lat[begin : begin + step], lon[begin : begin + step]
            bound = np.full(len(y), np.inf if radius is None else radius)
            done = np.zeros(len(y), bool)
            place, node = np.arange(len(y)), np.zeros(len(y), np.int64)
            for boxes in [*self.levels, None]:
                if boxes is None:
                    node = self.items[node].ravel()
                    place, boxes = np.repeat(place, self.items.shape[1]), self.boxes
                else:
                    node = (node[:, None] * 2 + np.arange(2)).ravel()
                    place = np.repeat(place, 2)
                near, far = self._reach(boxes[node], y[place], x[place])
                if radius is None:
                    if len(place):
                        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                        bound[place[starts]] = np.minimum(bound[place[starts]], np.minimum.reduceat(far, starts))
                    alive = near <= bound[place]
                else:
                    done[place[far < radius]] = True
                    alive = (near < radius) & ~done[place]
                place, node = place[alive], node[alive]
            real = (node < self.size) & ~done[place]
            yield place[real] + begin, node[real], np.flatnonzero(done) + begin
