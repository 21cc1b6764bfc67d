"""Dense numpy kernels over stacks of images (n, h, w, c) and of vectors (..., d)."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


# --- extraction ---------------------------------------------------------------------------------------------------


def patches(x: np.ndarray, size: tuple[int, int], stride: int) -> np.ndarray:
    """(n, h', w', ph*pw*c): all patches, elements in (row, column, channel) order."""
    view = np.lib.stride_tricks.sliding_window_view(x, size, axis=(1, 2))[:, ::stride, ::stride]
    out = view.transpose(0, 1, 2, 4, 5, 3)
    return np.ascontiguousarray(out).reshape(*out.shape[:3], -1)


def derivative_filters(sigma: float, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vertical and horizontal derivative of a Gaussian, absolute values summing to 2 each."""
    half = int(2 * np.ceil(sigma)) if width is None else width // 2
    squares = np.arange(-half, half + 1, dtype=np.float64) ** 2
    bell = np.exp(-(squares[:, None] + squares) / (2 * (sigma + EPS) ** 2))
    return tuple(2 * g / np.abs(g).sum() for g in np.gradient(bell / bell.sum()))


def convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """True convolution of (n, h, w) with an odd kernel; outside pixels repeat the edge."""
    kh, kw = kernel.shape
    padded = np.pad(x, ((0, 0), (kh // 2, kh // 2), (kw // 2, kw // 2)), mode="edge")
    return np.einsum("nhwij,ij->nhw", np.lib.stride_tricks.sliding_window_view(padded, (kh, kw), axis=(1, 2)), kernel[::-1, ::-1])


def gray(x: np.ndarray) -> np.ndarray:
    """Intensities above 1 are scaled from 0..255; channels are averaged."""
    big = x.reshape(len(x), -1).max(1) > 1 if x.size else np.zeros(len(x), bool)
    return np.where(big[:, None, None, None], x / 255.0, x).mean(-1)


def oriented_gradients(x: np.ndarray, sigma: float = 1.0, angles: int = 8, alpha: float = 9.0, twoside: bool = True) -> np.ndarray:
    g, (fh, fw) = gray(x), derivative_filters(sigma)
    dh, dw = convolved(g, fh), convolved(g, fw)
    size, theta = np.hypot(dh, dw), np.arctan2(dh, dw)
    at = np.arange(angles) * (2 if twoside else 1) * np.pi / angles
    power = np.cos(theta[..., None] - at) ** alpha
    return size[..., None] * (np.maximum(power, 0) if twoside else np.abs(power))


def _bin_weights(size: int, bins: int) -> np.ndarray:
    """(bins^2, size^2): each pixel's bilinear share in each bin."""
    centre = (2 * np.arange(bins) + 1) * size / (2 * bins) - 0.5
    share = np.clip(1 - np.abs(np.arange(size)[None, :] - centre[:, None]) * bins / size, 0, None)
    return np.einsum("ai,bj->abij", share, share).reshape(bins * bins, size * size)


def dense_sift(x: np.ndarray, size: int, stride: int, contrast: float = 1.0, sigma: float = 1.0, most: float = 0.2) -> np.ndarray:
    """(n, rows, cols, 128); images smaller than a patch give (n, 0, 0, 128). Cells run row by row, and in each the angles."""
    n, h, w, _ = x.shape
    if h < size or w < size:
        return np.zeros((n, 0, 0, 128))
    maps = oriented_gradients(x, sigma)
    rows = np.arange((h - size) % stride // 2, h - size + 1, stride)
    cols = np.arange((w - size) % stride // 2, w - size + 1, stride)
    view = np.lib.stride_tricks.sliding_window_view(maps, (size, size), axis=(1, 2))[:, rows][:, :, cols]
    feats = np.einsum("bp,nrcap->nrcba", _bin_weights(size, 4), view.reshape(*view.shape[:4], -1)).reshape(n, len(rows), len(cols), 128)
    return sift_normalized(feats, contrast, most)


def sift_normalized(feats: np.ndarray, contrast: float = 1.0, most: float = 0.2) -> np.ndarray:
    length = np.sqrt((feats**2).sum(-1, keepdims=True))
    out = np.minimum(feats / np.maximum(length, contrast), most)
    again = np.sqrt((out**2).sum(-1, keepdims=True))
    return np.where(length >= contrast, out / np.where(again > 0, again, 1), out)


# --- resampling ---------------------------------------------------------------------------------------------------


def _bilinear(x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Values at fractional positions (same shape rows, cols); outside positions take the nearest edge."""
    h, w = x.shape[1:3]
    rows, cols = np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)
    r0, c0 = np.floor(rows).astype(int), np.floor(cols).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (rows - r0)[..., None], (cols - c0)[..., None]
    return (x[:, r0, c0] * (1 - fr) + x[:, r1, c0] * fr) * (1 - fc) + (x[:, r0, c1] * (1 - fr) + x[:, r1, c1] * fr) * fc


def spline_weights(n: int, at: np.ndarray) -> np.ndarray:
    """(len(at), n): the share of each of n samples in the not-a-knot cubic spline through them, at positions 0 .. n-1."""
    a, b = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2], b[i, i - 1 : i + 2] = (1, 4, 1), (6, -12, 6)
    a[0, :3] = a[-1, -3:] = (1, -2, 1)
    second = np.linalg.solve(a, b)
    at = np.clip(at, 0, n - 1)
    i = np.minimum(np.floor(at).astype(int), n - 2)
    u = (at - i)[:, None]
    eye = np.eye(n)
    return (1 - u) * eye[i] + u * eye[i + 1] + ((1 - u) ** 3 - (1 - u)) / 6 * second[i] + (u**3 - u) / 6 * second[i + 1]


def _bicubic(x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The bicubic spline through all pixels; images of under 4 rows or columns are interpolated linearly."""
    h, w = x.shape[1:3]
    if min(h, w) < 4:
        return _bilinear(x, rows, cols)
    wr, wc = spline_weights(h, rows.ravel()), spline_weights(w, cols.ravel())
    return np.einsum("pi,nijc,pj->npc", wr, x, wc, optimize=True).reshape(len(x), *rows.shape, x.shape[-1])


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned, edges repeated."""
    h, w = x.shape[1:3]
    rows = (np.arange(height) + 0.5) * h / height - 0.5
    cols = (np.arange(width) + 0.5) * w / width - 0.5
    return _bilinear(x, *np.meshgrid(rows, cols, indexing="ij"))


def jittered(x: np.ndarray, translation: tuple[float, float], rotation: float, scaling: float, cubic: bool = True) -> np.ndarray:
    """Turned about the centre, moved and scaled by 2^scaling; every output pixel is looked up in the input."""
    h, w = x.shape[1:3]
    middle = np.array([h, w]) / 2 - 0.5
    r, c = np.meshgrid(np.arange(h) - middle[0], np.arange(w) - middle[1], indexing="ij")
    cos, sin = np.cos(rotation), np.sin(rotation)
    shrink = 2.0**-scaling
    rows = (r * cos + c * sin - translation[0]) * shrink + middle[0]
    cols = (-r * sin + c * cos - translation[1]) * shrink + middle[1]
    return (_bicubic if cubic else _bilinear)(x, rows, cols)


# --- normalisation ------------------------------------------------------------------------------------------------


def normalized(x: np.ndarray, kind: str, reg: float = EPS, channels: int = 1) -> np.ndarray:
    """kind: mean, meanvar, spatial, l2 or l1, along the last axis."""
    if kind == "mean":
        return x - x.mean(-1, keepdims=True)
    if kind == "meanvar":
        return (x - x.mean(-1, keepdims=True)) / (x.std(-1, keepdims=True) + reg)
    if kind == "spatial":
        y = x.reshape(*x.shape[:-1], -1, channels)
        return (y - y.mean(-2, keepdims=True)).reshape(x.shape)
    if kind == "l2":
        return x / (np.sqrt((x * x).sum(-1, keepdims=True)) + reg)
    if kind == "l1":
        return x / (x.sum(-1, keepdims=True) + reg)
    raise ValueError(f"unknown normalisation {kind}")


# --- encoding -----------------------------------------------------------------------------------------------------


def squared_distances(x: np.ndarray, atoms: np.ndarray) -> np.ndarray:
    """By one product; where that cancels (a vector that is nearly an atom) by differences."""
    own, theirs = (x * x).sum(-1, keepdims=True), (atoms * atoms).sum(-1)
    d = own - 2 * x @ atoms.T + theirs
    near = np.nonzero(d <= 1e-6 * (own + theirs))
    if len(near[0]):
        d[near] = ((x[near[:-1]] - atoms[near[-1]]) ** 2).sum(-1)
    return d


def one_hot_nearest(x: np.ndarray, atoms: np.ndarray) -> np.ndarray:
    return np.eye(len(atoms))[squared_distances(x, atoms).argmin(-1)]


def thresholded(x: np.ndarray, atoms: np.ndarray, alpha: float = 0.25, twoside: bool | str = True) -> np.ndarray:
    """Responses above alpha: of both signs side by side, of the positive side, or ('abs') of the absolute value."""
    p = x @ atoms.T
    if twoside == "abs":
        p = np.abs(p)
    elif twoside:
        p = np.concatenate((p, -p), -1)
    return np.maximum(p - alpha, 0)


def triangled(x: np.ndarray, atoms: np.ndarray) -> np.ndarray:
    d = np.sqrt(squared_distances(x, atoms))
    return np.maximum(d.mean(-1, keepdims=True) - d, 0)


def locality_coded(x: np.ndarray, atoms: np.ndarray, k: int = 5, reg: float = 1e-4) -> np.ndarray:
    """Weights of sum 1 over the k nearest atoms that best rebuild each vector, regularised by the Gram matrix's trace."""
    flat = x.reshape(-1, x.shape[-1])
    score = (atoms * atoms).sum(1) / 2 - flat @ atoms.T
    near = np.sort(np.argpartition(score, min(k, score.shape[1]) - 1, axis=1)[:, :k], axis=1)
    z = atoms[near] - flat[:, None, :]
    gram = z @ z.transpose(0, 2, 1)
    trace = np.trace(gram, axis1=1, axis2=2)
    gram += (reg * np.where(trace > 0, trace, 1))[:, None, None] * np.eye(near.shape[1])
    w = np.linalg.solve(gram, np.ones((len(flat), near.shape[1], 1)))[..., 0]
    out = np.zeros((len(flat), len(atoms)))
    np.put_along_axis(out, near, w / w.sum(1, keepdims=True), 1)
    return out.reshape(*x.shape[:-1], len(atoms))


def matching_pursuit(x: np.ndarray, atoms: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, signed value) of each greedy step; the residual's responses follow from the Gram matrix."""
    dots, gram = x @ atoms.T, atoms @ atoms.T
    index, value, rows = np.empty((len(x), steps), np.int64), np.empty((len(x), steps)), np.arange(len(x))
    for s in range(steps):
        index[:, s] = np.abs(dots).argmax(1)
        value[:, s] = dots[rows, index[:, s]]
        dots = dots - gram[index[:, s]] * value[:, s : s + 1]
    return index, value


# --- pooling ------------------------------------------------------------------------------------------------------


def _pool(cells: np.ndarray, method: str, floor: bool = True) -> np.ndarray:
    """Pool (n, m, c) over m. The maximum starts from 0; a cell without pixels is 0 for max and NaN otherwise."""
    if method == "max":
        if cells.shape[1] == 0:
            return np.zeros((len(cells), cells.shape[2]))
        return np.maximum(cells.max(1), 0) if floor else cells.max(1)
    if cells.shape[1] == 0:
        return np.full((len(cells), cells.shape[2]), np.nan)
    if method == "ave":
        return cells.mean(1)
    if method == "rms":
        return np.sqrt((cells * cells).mean(1))
    raise ValueError(f"unknown pooling method {method}")


def spatial_pooled(x: np.ndarray, grid: tuple[int, int], method: str) -> np.ndarray:
    n, h, w, c = x.shape
    rows, cols = np.arange(h) * grid[0] // max(h, 1), np.arange(w) * grid[1] // max(w, 1)
    out = np.empty((n, *grid, c))
    for a in range(grid[0]):
        for b in range(grid[1]):
            out[:, a, b] = _pool(x[:, rows == a][:, :, cols == b].reshape(n, -1, c), method)
    return out


def rectangles(grid: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """All (top, bottom, left, right) of cells, ends excluded, in (top, bottom, left, right) order."""
    gh, gw = grid
    return [(i, j, k, m) for i in range(gh) for j in range(i + 1, gh + 1) for k in range(gw) for m in range(k + 1, gw + 1)]


def overcomplete_pooled(x: np.ndarray, grid: tuple[int, int], method: str) -> np.ndarray:
    """(n, rectangles, c): every rectangle of grid cells, pooled over the cells' pooled values."""
    cells = x if x.shape[1:3] == tuple(grid) else spatial_pooled(x, grid, method)
    n, c = len(x), x.shape[-1]
    return np.stack([_pool(cells[:, i:j, k:m].reshape(n, -1, c), method) for i, j, k, m in rectangles(grid)], 1)


def pyramid_pooled(x: np.ndarray, levels, method: str) -> np.ndarray:
    levels = range(levels) if isinstance(levels, int) else levels
    return np.concatenate([spatial_pooled(x, (2**i, 2**i), method).reshape(len(x), -1) for i in levels], 1)


def fixed_size_pooled(x: np.ndarray, size: tuple[int, int], method: str) -> np.ndarray:
    h, w = x.shape[1:3]
    grid = (h // size[0], w // size[1])
    top, left = (h - grid[0] * size[0]) // 2, (w - grid[1] * size[1]) // 2
    return spatial_pooled(x[:, top : top + grid[0] * size[0], left : left + grid[1] * size[1]], grid, method)


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    """exp(-r^2 / 2 sigma^2), not normalised; the size is odd and at least 3."""
    half = max(size, 3) // 2
    squares = np.arange(-half, half + 1, dtype=np.float64) ** 2
    return np.exp(-(squares[:, None] + squares) / (2 * sigma * sigma))


def uniform_kernel(size: int | tuple[int, int]) -> np.ndarray:
    """Ones, not normalised; a number is the edge of a square."""
    return np.ones((size, size) if isinstance(size, int) else size)


def kernel_pooled(x: np.ndarray, kernel: np.ndarray, stride: tuple[int, int], method, full: bool = False) -> np.ndarray:
    """Windows weighted by the kernel, then pooled; without `full` the last window of each axis is left off.

    method: max (not floored), ave, rms, or an object with dim(width) and pool(array of (m, width)) -> (dim,)."""
    n, h, w, c = x.shape
    kh, kw = kernel.shape
    grid = (max((h - kh) // stride[0] + full, 0), max((w - kw) // stride[1] + full, 0))
    width = c if isinstance(method, str) else method.dim(c)
    out = np.zeros((n, *grid, width))
    top, left = ((s - ((g - full) * t + k)) // 2 for s, g, t, k in ((h, grid[0], stride[0], kh), (w, grid[1], stride[1], kw)))
    for i in range(grid[0]):
        for j in range(grid[1]):
            r, q = top + i * stride[0], left + j * stride[1]
            cells = (x[:, r : r + kh, q : q + kw] * kernel[:, :, None]).reshape(n, -1, c)
            out[:, i, j] = _pool(cells, method, floor=False) if isinstance(method, str) else np.stack([method.pool(z) for z in cells])
    return out
