"""Homographies and least squares."""

from __future__ import annotations

import numpy as np


def project(h: np.ndarray, p: np.ndarray, least: float = 1e-10) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ np.asarray(h, dtype=np.float64).reshape(3, 3).T
    w = np.where(np.abs(q[:, 2]) < least, np.where(q[:, 2] < 0, -least, least), q[:, 2])
    return q[:, :2] / w[:, None]


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The projective map of four or more point pairs, last entry 1, by least squares over scaled points; null if degenerate."""
    if len(src) < 4:
        return None

    def scaled(p):
        mean, spread = p.mean(axis=0), max(np.abs(p - p.mean(axis=0)).max(), 1e-12)
        return (p - mean) / spread, np.array([[1 / spread, 0, -mean[0] / spread], [0, 1 / spread, -mean[1] / spread], [0, 0, 1]])

    (s, ts), (d, td) = scaled(np.asarray(src, float)), scaled(np.asarray(dst, float))
    x, y, u, v = s[:, 0], s[:, 1], d[:, 0], d[:, 1]
    one, zero = np.ones(len(x)), np.zeros(len(x))
    a = np.concatenate([np.column_stack([x, y, one, zero, zero, zero, -u * x, -u * y]), np.column_stack([zero, zero, zero, x, y, one, -v * x, -v * y])])
    solution, _, rank, _ = np.linalg.lstsq(a, np.concatenate([u, v]), rcond=1e-10)
    if rank < 8:
        return None
    h = np.linalg.inv(td) @ np.append(solution, 1).reshape(3, 3) @ ts
    return (h / h[2, 2]).ravel() if abs(h[2, 2]) > 1e-12 else None


def invert(h: np.ndarray) -> np.ndarray | None:
    m = np.asarray(h, float).reshape(3, 3)
    return np.linalg.inv(m).ravel() if abs(np.linalg.det(m)) >= 1e-12 else None


def ransac(src: np.ndarray, dst: np.ndarray, iterations: int = 500, threshold: float = 3.0, seed: int = 42, refit: bool = True) -> tuple[np.ndarray, int, bool]:
    """The map with the most pairs within the threshold, their number, and whether there is one; the first of equals."""
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    identity = np.eye(3).ravel()
    if len(src) < 4:
        return identity, 0, False
    rng, best, most, inside = np.random.default_rng(seed), identity, 0, None
    for _ in range(iterations):
        pick = rng.choice(len(src), 4, replace=False)
        h = homography(src[pick], dst[pick])
        if h is None:
            continue
        near = np.hypot(*(project(h, src) - dst).T) < threshold
        if near.sum() > most:
            best, most, inside = h, int(near.sum()), near
    if refit and inside is not None and most > 4 and (h := homography(src[inside], dst[inside])) is not None:
        count = int((np.hypot(*(project(h, src) - dst).T) < threshold).sum())
        if count >= most:
            best, most = h, count
    return best, most, most > 0


def batched_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products of a batch (batch x m x k, batch x k x n): factors in half precision, sums in single."""
    half = [x.astype(np.float16).astype(np.float32) for x in (a, b)]
    return np.matmul(*half)


def damped_step(jacobian: np.ndarray, residual: np.ndarray, damping: float) -> np.ndarray | None:
    """Solve (J'J with its diagonal times 1 + damping) d = -J'r."""
    return damped_solve(jacobian.T @ jacobian, jacobian.T @ residual, damping)


def damped_solve(normal: np.ndarray, gradient: np.ndarray, damping: float) -> np.ndarray | None:
    """The same from J'J and J'r; null if the matrix is not positive."""
    a = normal.copy()
    a[np.diag_indices_from(a)] = np.maximum(np.diag(a) * (1 + damping), 1e-10)
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(low.T, np.linalg.solve(low, -gradient))


def _mapped(h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points after a map (eight parameters), and the derivatives by the parameters: n x 2 and n x 2 x 8."""
    x, y = p[:, 0], p[:, 1]
    w = h[6] * x + h[7] * y + 1
    w = np.where(np.abs(w) < 1e-10, np.where(w < 0, -1e-10, 1e-10), w)
    u, v = (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w
    d = np.zeros((len(p), 2, 8))
    for row, value, first in ((0, u, 0), (1, v, 3)):
        d[:, row, first], d[:, row, first + 1], d[:, row, first + 2] = x / w, y / w, 1 / w
        d[:, row, 6], d[:, row, 7] = -value * x / w, -value * y / w
    return np.column_stack([u, v]), d


def pair_equations(ha: np.ndarray, hb: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """What one pair of images adds to the normal equations: squared residual, 16 x 16 matrix and gradient (a's parameters, then b's)."""
    p, da = _mapped(ha, rows[:, :2])
    q, db = _mapped(hb, rows[:, 2:])
    r = (p - q).ravel()
    j = np.concatenate([da, -db], axis=2).reshape(len(r), 16)
    return float(r @ r), j.T @ j, j.T @ r


class BundleAdjustment:
    """Levenberg-Marquardt over one homography per image; the first image stays.

    Correspondences are rows (image a, image b, xa, ya, xb, yb). A row's residual is the difference of
    both points after their images' maps. State can be saved and taken up again.
    """

    def __init__(self, images: list[int], rows: np.ndarray, state: dict | None = None):
        self.images, self.rows = list(images), np.asarray(rows, float).reshape(-1, 6)
        place = {k: i - 1 for i, k in enumerate(self.images)}
        self.a = np.array([place[int(k)] for k in self.rows[:, 0]], dtype=np.int64)
        self.b = np.array([place[int(k)] for k in self.rows[:, 1]], dtype=np.int64)
        start = np.tile(np.eye(3).ravel()[:8], len(self.images) - 1)
        self.state = state or {"iteration": 0, "lambda": 1e-3, "parameters": start.tolist(), "converged": False}

    def maps(self, parameters: np.ndarray) -> np.ndarray:
        p = np.concatenate([np.eye(3).ravel()[None, :8], np.asarray(parameters).reshape(-1, 8)])
        return np.column_stack([p, np.ones(len(p))])

    def residual(self, parameters: np.ndarray) -> np.ndarray:
        h = self.maps(parameters)

        def mapped(which, x, y):
            m = h[which + 1]
            w = m[:, 6] * x + m[:, 7] * y + m[:, 8]
            w = np.where(np.abs(w) < 1e-10, np.where(w < 0, -1e-10, 1e-10), w)
            return np.stack([(m[:, 0] * x + m[:, 1] * y + m[:, 2]) / w, (m[:, 3] * x + m[:, 4] * y + m[:, 5]) / w])

        return (mapped(self.a, self.rows[:, 2], self.rows[:, 3]) - mapped(self.b, self.rows[:, 4], self.rows[:, 5])).ravel()

    def step(self, eps: float = 1e-3) -> bool:
        """One iteration; True once an accepted step gains next to nothing."""
        p = np.array(self.state["parameters"])
        r = self.residual(p)
        j = np.empty((len(r), len(p)))
        for k in range(len(p)):
            up, down = p.copy(), p.copy()
            up[k] += eps
            down[k] -= eps
            j[:, k] = (self.residual(up) - self.residual(down)) / (2 * eps)
        d = damped_step(j, r, self.state["lambda"])
        before = float(r @ r)
        trial = None if d is None else self.residual(p + d)
        self.state["iteration"] += 1
        if trial is not None and float(trial @ trial) < before:
            self.state |= {"parameters": (p + d).tolist(), "lambda": self.state["lambda"] / 10, "converged": before - float(trial @ trial) < 1e-4}
        else:
            self.state["lambda"] *= 10
            self.state["converged"] = before < 1e-12 or self.state["lambda"] > 1e12
        return self.state["converged"]

    def run(self, most: int = 100, save=None, every: int = 5) -> dict[int, np.ndarray]:
        """image -> homography; ``save`` gets the state every few iterations."""
        while len(self.rows) and len(self.images) > 1 and not self.state["converged"] and self.state["iteration"] < most:
            self.step()
            if save and self.state["iteration"] % every == 0:
                save(self.state)
        return dict(zip(self.images, self.maps(np.array(self.state["parameters"])), strict=True))
