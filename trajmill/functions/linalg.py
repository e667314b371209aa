"""Small dense algebra on triangular factors and model matrices (NumPy only).

Everything here works on matrices whose size depends on the number of columns, never on the
number of rows; the rows are reduced on the executors.
"""

from __future__ import annotations

import numpy as np


def stack_factor(factor: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """Fold a block of rows into a triangular factor: QR of the stacked rows.

    With fewer rows than columns the stack itself is kept: it is as small as a factor.
    """
    rows = block if factor is None else np.vstack([factor, block])
    return np.linalg.qr(rows, mode="r") if rows.shape[0] > rows.shape[1] else rows


def pick_rank(s: np.ndarray, rank, rows: int | None = None) -> int:
    """Rank rule: None/"full", "auto", a positive int, or an energy share in (0, 1]."""
    if rank is None or rank == "full":
        r = len(s)
    elif rank == "auto":
        r = int((s > s.max(initial=0.0) * max(rows or 0, len(s)) * np.finfo(float).eps).sum())
    elif isinstance(rank, (int, np.integer)) and not isinstance(rank, bool):
        if rank < 1:
            raise ValueError("rank must be at least 1")
        r = int(rank)
    else:
        if not 0.0 < float(rank) <= 1.0:
            raise ValueError("an energy share must lie in (0, 1]")
        r = int(np.searchsorted(energy_curve(s), float(rank), side="left")) + 1
    return int(min(max(r, 1), len(s)))


def energy_curve(s: np.ndarray) -> np.ndarray:
    """Cumulative share of the squared singular values."""
    energy = np.cumsum(np.asarray(s, float) ** 2)
    return energy / energy[-1] if len(energy) and energy[-1] > 0 else np.ones_like(energy)


def spectral_solve(omega: np.ndarray, target: np.ndarray, rank=None, rcond: float | None = 1e-12,
                   alpha: float = 0.0, rows: int | None = None):
    """Minimise ``|omega G' - target|`` on the leading singular directions of ``omega``.

    Returns ``(G, singular values, rank used)``; ``alpha`` > 0 damps by ``s / (s**2 + alpha)``.
    """
    p, s, wt = np.linalg.svd(omega, full_matrices=False)
    r = pick_rank(s, rank, rows)
    if rcond is not None:
        r = min(r, max(1, int((s > rcond * s[0]).sum())))
    inverse = s[:r] / (s[:r] ** 2 + alpha) if alpha > 0 else _reciprocal(s[:r])
    g_t = wt[:r].T @ (inverse[:, None] * (p[:, :r].T @ target))
    return g_t.T, s, r


def _reciprocal(s: np.ndarray) -> np.ndarray:
    return np.divide(1.0, s, out=np.zeros_like(s), where=s > 0)


def expm(a: np.ndarray) -> np.ndarray:
    """Exponential of a matrix, or of every matrix of a stack: scaling and squaring around a diagonal Pade approximant."""
    a = np.asarray(a, float)
    size = np.abs(a).sum(axis=-2).max(axis=-1)
    halvings = np.ceil(np.log2(np.maximum(size, 0.5) / 0.5)).astype(int)
    x = a / np.exp2(halvings)[..., None, None]
    q = 8
    c, term = 1.0, np.broadcast_to(np.eye(a.shape[-1]), a.shape)
    top, bottom = term, term
    for j in range(1, q + 1):
        c *= (q - j + 1) / (j * (2 * q - j + 1))
        term = x @ term
        top = top + c * term
        bottom = bottom + (-1) ** j * c * term
    e = np.linalg.solve(bottom, top)
    for k in range(int(halvings.max(initial=0))):
        e = np.where((halvings > k)[..., None, None], e @ e, e)
    return e


def logm(a: np.ndarray) -> np.ndarray:
    """Real part of the principal logarithm: square roots until near one, then a series."""
    x = np.asarray(a, complex)
    n = len(x)
    values, vectors = np.linalg.eig(x)
    if np.linalg.cond(vectors) < 1e8 and np.all(values != 0):
        return (vectors @ np.diag(np.log(values)) @ np.linalg.inv(vectors)).real
    roots = 0
    while np.linalg.norm(x - np.eye(n), 1) > 0.25 and roots < 64:
        x = _sqrtm(x)
        roots += 1
    # log(x) = 2 artanh(w) with w = (x - 1)(x + 1)^-1
    w = np.linalg.solve(x + np.eye(n), x - np.eye(n))
    total, power = np.zeros_like(w), w
    for k in range(1, 60, 2):
        total, power = total + power / k, power @ w @ w
    return (2.0 * total * 2.0**roots).real


def _sqrtm(a: np.ndarray) -> np.ndarray:
    y, z = a, np.eye(len(a), dtype=complex)
    for _ in range(60):  # Denman-Beavers iteration
        y_next = 0.5 * (y + np.linalg.pinv(z))
        z = 0.5 * (z + np.linalg.pinv(y))
        done = np.linalg.norm(y_next - y, 1) <= 1e-15 * max(np.linalg.norm(y_next, 1), 1e-300)
        y = y_next
        if done:
            break
    return y


def hold_step(a_c: np.ndarray, b_c: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Discrete (A, B) of a continuous system whose input is held for ``dt``."""
    n, m = a_c.shape[0], b_c.shape[1]
    block = np.zeros((n + m, n + m))
    block[:n, :n], block[:n, n:] = a_c, b_c
    e = expm(block * dt)
    return e[:n, :n], e[:n, n:]


def hold_steps(a_c: np.ndarray, b_c: np.ndarray, dts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``hold_step`` for every time step of an array; equal steps share one exponential."""
    n, m = a_c.shape[0], b_c.shape[1]
    steps, place = np.unique(np.asarray(dts, float), return_inverse=True)
    block = np.zeros((n + m, n + m))
    block[:n, :n], block[:n, n:] = a_c, b_c
    e = expm(block * steps[:, None, None])[place]
    return e[:, :n, :n], e[:, :n, n:]


def to_continuous(a_d: np.ndarray, b_d: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Continuous-time matrices whose held step of ``dt`` gives the discrete ones."""
    n = len(a_d)
    a_c = logm(a_d) / dt
    try:
        m = np.linalg.solve(a_c, a_d - np.eye(n))
    except np.linalg.LinAlgError:
        m = dt * np.eye(n)
    b_c = np.linalg.lstsq(m, b_d, rcond=None)[0] if b_d.shape[1] else b_d
    return a_c, b_c


def pivot_order(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column order and |diagonal| of a QR with column pivoting (largest remaining norm first)."""
    work = np.array(m, float)
    rows, cols = work.shape
    order, diagonal = np.arange(cols), []
    for k in range(min(rows, cols)):
        norms = np.linalg.norm(work[k:, k:], axis=0)
        j = k + int(np.argmax(norms))
        work[:, [k, j]], order[[k, j]] = work[:, [j, k]], order[[j, k]]
        v = work[k:, k].copy()
        length = np.linalg.norm(v)
        diagonal.append(length)
        if length > 0:
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            work[k:, k:] -= 2.0 * np.outer(v, v @ work[k:, k:])
    return order, np.array(diagonal)


def fixed_signs(modes: np.ndarray) -> np.ndarray:
    """Make the entry of largest magnitude of every column positive."""
    peak = modes[np.argmax(np.abs(modes), axis=0), np.arange(modes.shape[1])]
    return modes * np.where(peak < 0, -1.0, 1.0)


def affine_scan(a: np.ndarray, forcing: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of ``x[k] = a x[k-1] + forcing[k]`` restarted where ``first`` is True.

    At a restart row ``x = forcing``. The scan doubles its stride, so it takes log2(longest
    run) vectorised steps, whatever mix of short and long runs a batch holds.
    """
    x = np.array(forcing, float)
    if not len(x):
        return x
    starts = np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
    offset = np.arange(len(x)) - starts
    power, stride, longest = np.array(a, float), 1, int(offset.max())
    while stride <= longest:
        reach = np.flatnonzero(offset >= stride)
        x[reach] = x[reach] + x[reach - stride] @ power.T
        power, stride = power @ power, 2 * stride
    return x


SPAN = 256  # rows whose matrices are multiplied together before states carry on; bounds the growth of products


def varying_scan(m: np.ndarray, forcing: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of ``x[k] = m[k] x[k-1] + forcing[k]`` with a matrix per row, restarted where ``first`` is True.

    Neighbouring steps are composed in pairs, the composed half is scanned the same way, and the states left out follow from their
    predecessors: about two matrix products a row in log2(SPAN) vectorised levels. Spans follow one another.
    """
    x = np.array(forcing, float)
    m = np.where(first[:, None, None], 0.0, m)
    for lo in range(0, len(x), SPAN):
        part = x[lo: lo + SPAN]
        if lo:
            part[0] += m[lo] @ x[lo - 1]
        x[lo: lo + SPAN] = _pairwise_scan(m[lo: lo + SPAN], part)
    return x


def _pairwise_scan(m: np.ndarray, f: np.ndarray) -> np.ndarray:
    if len(f) == 1:
        return f
    odd = np.einsum("kij,kj->ki", m[1::2], f[: len(f) - 1: 2]) + f[1::2]
    x = np.empty_like(f)
    x[1::2] = _pairwise_scan(m[1::2] @ m[: len(f) - 1: 2], odd)
    x[0] = f[0]
    x[2::2] = f[2::2] + np.einsum("kij,kj->ki", m[2::2], x[1: len(f) - 1: 2])
    return x


def chain_product(m: np.ndarray) -> np.ndarray:
    """``m[-1] @ ... @ m[0]`` by halving."""
    while len(m) > 1:
        paired = m[1::2] @ m[: len(m) - len(m) % 2: 2]
        m = np.concatenate([paired, m[-1:]]) if len(m) % 2 else paired
    return m[0]


class RiccatiScan:
    """Gains and covariances of a time-invariant Kalman filter at any step, without the steps before it.

    The filtered covariance moves by a linear-fractional map ``P -> C + A P (I + J P)^-1 A'``, and such maps compose into
    one of the same form (the covariance part of the associative filtering elements of Sarkka and Garcia-Fernandez, 2021). Maps of 1, 2, 4,
    ... steps are kept; a step k is reached through the binary digits of k, and a run of steps is filled by doubling. Memory
    is a few small matrices, however long a case is and whether or not the covariance ever settles.

    Step 0 updates ``p0`` without a prediction. A singular innovation covariance (channels without any noise) has no such
    map; then covariances are stepped through, holding one of every STRIDE.
    """

    STRIDE = 1024

    def __init__(self, a, h, q, r, p0):
        self.a, self.h, self.q, self.r = (np.asarray(x, float) for x in (a, h, q, r))
        self.eye = np.eye(len(self.a))
        self.first = self._update(np.asarray(p0, float)[None])
        noise = self.h @ self.q @ self.h.T + self.r
        self.regular = np.linalg.matrix_rank(noise, hermitian=True) == len(noise)
        self.kept = {0: self.first[1][0]}
        gain = self.q @ self.h.T @ np.linalg.pinv(noise)
        ha = self.h @ self.a
        keep = self.eye - gain @ self.h
        self.maps = [(keep @ self.a, keep @ self.q, ha.T @ np.linalg.pinv(noise) @ ha)]
        self.last = None

    def _update(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain and covariance after the measurement, for a stack of covariances before it."""
        k = p @ self.h.T @ np.linalg.pinv(self.h @ p @ self.h.T + self.r, hermitian=True)
        after = (self.eye - k @ self.h) @ p
        return k, (after + np.swapaxes(after, -1, -2)) / 2

    def _map(self, level: int):
        """The map of 2**level steps, or the longest shorter one whose entries are finite."""
        while len(self.maps) <= level:
            a, c, j = self.maps[-1]
            left = np.linalg.solve(self.eye + c @ j, a).T  # ((I + C J)^-1 A)'
            with np.errstate(over="ignore", invalid="ignore"):
                wide = (a @ left.T, a @ np.linalg.solve(self.eye + c @ j, c) @ a.T + c, left @ j @ a + j)
            if not all(np.isfinite(x).all() for x in wide):
                break
            self.maps.append(wide)
        level = min(level, len(self.maps) - 1)
        return level, self.maps[level]

    def _moved(self, p: np.ndarray, steps: int) -> np.ndarray:
        """Covariances ``steps`` later, for a stack."""
        while steps:
            level, (a, c, j) = self._map(steps.bit_length() - 1)
            p = a @ np.linalg.solve(self.eye + p @ j, p) @ a.T + c
            p = (p + np.swapaxes(p, -1, -2)) / 2
            steps -= 1 << level
        return p

    def run(self, begin: int, count: int) -> np.ndarray:
        """Filtered covariances of steps begin, ..., begin + count - 1."""
        out = np.empty((count, *self.eye.shape))
        if self.regular:
            out[:1] = self._moved(self.first[1], begin)
            done = 1
            while done < count:
                more = min(done, count - done)
                out[done: done + more] = self._moved(out[:more], done)
                done += more
            return out
        at = max(k for k in self.kept if k <= begin)
        p = self.kept[at]
        for k in range(at, begin + count):
            if k > at:
                p = self._update((self.a @ p @ self.a.T + self.q)[None])[1][0]
            if k % self.STRIDE == 0:
                self.kept[k] = p
            if k >= begin:
                out[k - begin] = p
        return out

    def at(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gain, filtered covariance) of every step in ``index``, which may repeat and mix runs."""
        if self.last is None or not np.array_equal(self.last[0], index):
            steps, place = np.unique(index, return_inverse=True)
            before = np.unique(np.maximum(steps - 1, 0))
            edge = np.flatnonzero(np.diff(before, prepend=before[:1] - 2) != 1) if len(before) else np.zeros(0, int)
            runs = [self.run(int(run[0]), len(run)) for run in np.split(before, edge[1:])] if len(before) else []
            p = np.concatenate(runs)[np.searchsorted(before, np.maximum(steps - 1, 0))] if runs else np.empty((0, *self.eye.shape))
            gains, after = self._update(self.a @ p @ self.a.T + self.q)
            zero = steps == 0
            gains[zero], after[zero] = self.first
            self.last = np.array(index), gains[place], after[place]
        return self.last[1], self.last[2]
