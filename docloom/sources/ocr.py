"""OCR of page images: preparing images in numpy, the means of confidences, and the choice between attempts.

The recogniser is plugged in: read(image) gives (text, word confidences as strings). Images are arrays of grey or RGB bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Widths, contrasts, thresholds
MIN_WIDTH, SIGMA, OFFSET, REACH = 2000, 15, 10, 4
METHODS = {"adaptive": {"contrast": 1.5, "adaptive": True, "limit": 170}, "simple": {"cutoff": 1, "sharpen": True, "limit": 180}, "aggressive": {"contrast": 2.0, "median": 3, "sharpness": 2.0, "adaptive": True, "limit": 170}}
SHARPEN = np.array([[-2, -2, -2], [-2, 32, -2], [-2, -2, -2]]) / 16
SMOOTH = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13
GREY = (299, 587, 114)
# -----------------------------------------------------------------------------------------------------------------


def _round(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def _along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    reach = len(kernel) // 2
    pad = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
    out = np.zeros(x.shape)
    for k, w in enumerate(kernel):
        out += w * np.take(pad, np.arange(k, k + x.shape[axis]), axis)
    return out


def gaussian(image: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Weighted means of neighbours as far as REACH deviations; edges are mirrored."""
    at = np.arange(-int(REACH * sigma + 0.5), int(REACH * sigma + 0.5) + 1)
    kernel = np.exp(-0.5 * (at / sigma) ** 2)
    kernel /= kernel.sum()
    return _along(_along(image.astype(float), kernel, 0), kernel, 1)


def adaptive_threshold(image: np.ndarray) -> np.ndarray:
    """White where a pixel is over its neighbourhood's mean less an offset, else black."""
    return np.where(image > gaussian(image) - OFFSET, 255, 0).astype(np.uint8)


def _lanczos(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    scale = x.shape[axis] / size
    centre, support = (np.arange(size) + 0.5) * scale, 3 * max(scale, 1)
    at = np.arange(x.shape[axis]) + 0.5
    d = (at - centre[:, None]) / max(scale, 1)
    w = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0) * (np.abs(at - centre[:, None]) < support)
    return np.tensordot(w / w.sum(1, keepdims=True), x, (1, axis)) if axis == 0 else np.tensordot(x, w / w.sum(1, keepdims=True), (1, 1))


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    planes = image[..., None] if image.ndim == 2 else image
    out = np.stack([_round(_lanczos(_lanczos(planes[..., k].astype(float), width, 1), height, 0)) for k in range(planes.shape[2])], -1)
    return out[..., 0] if image.ndim == 2 else out


def _filtered(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A 3 x 3 filter; the rim stays."""
    out = x.astype(float)
    if min(x.shape) > 2:
        out[1:-1, 1:-1] = sum(kernel[i, j] * x[i : x.shape[0] - 2 + i, j : x.shape[1] - 2 + j].astype(float) for i in range(3) for j in range(3))
    return _round(out)


def _contrast(x: np.ndarray, factor: float) -> np.ndarray:
    mean = np.floor(x.mean() + 0.5)
    return np.clip(mean + factor * (x.astype(float) - mean), 0, 255).astype(np.uint8)


def _autocontrast(x: np.ndarray, cutoff: float) -> np.ndarray:
    """Stretched between the darkest and the lightest shade that are left without `cutoff` percent at either end."""
    cut, flat = int(x.size * cutoff // 100), np.sort(x.ravel())
    low, high = int(flat[min(cut, x.size - 1)]), int(flat[max(x.size - 1 - cut, 0)])
    return x if high <= low else np.clip((x.astype(float) - low) * (255.0 / (high - low)), 0, 255).astype(np.uint8)


def prepared(image: np.ndarray, method: str = "adaptive") -> np.ndarray:
    """Wide enough, grey, and black on white by one of METHODS."""
    plan = METHODS[method]
    if image.shape[1] < MIN_WIDTH:
        scale = MIN_WIDTH / image.shape[1]
        image = resized(image, int(image.shape[1] * scale), int(image.shape[0] * scale))
    grey = image if image.ndim == 2 else ((image[..., :3].astype(np.int64) * GREY).sum(-1) // 1000).astype(np.uint8)
    if "contrast" in plan:
        grey = _contrast(grey, plan["contrast"])
    if "cutoff" in plan:
        grey = _autocontrast(grey, plan["cutoff"])
    if "median" in plan:
        pad = np.pad(grey, 1, mode="edge")
        grey = np.median(np.stack([pad[i : i + grey.shape[0], j : j + grey.shape[1]] for i in range(3) for j in range(3)]), 0).astype(np.uint8)
    if "sharpen" in plan:
        grey = _filtered(grey, SHARPEN)
    if "sharpness" in plan:
        soft = _filtered(grey, SMOOTH).astype(float)
        grey = np.clip(soft + plan["sharpness"] * (grey - soft), 0, 255).astype(np.uint8)
    return adaptive_threshold(grey) if plan.get("adaptive") else np.where(grey > plan["limit"], 255, 0).astype(np.uint8)


def confidence_mean(words: list[str]) -> float:
    """The mean of the word confidences but for -1, which stands for no word; 0 without any."""
    known = [int(float(w)) for w in words if str(w) != "-1"]
    return sum(known) / len(known) if known else 0.0


def word_confidence(words: Column) -> Column:
    """The same for an array column of strings."""
    known = F.filter(words, lambda w: w != "-1")
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, w: s + w.cast("double")) / F.size(known)).otherwise(0.0)


def best_attempt(attempts: Column) -> Column:
    """attempts: array of (text, confidence) in their order. One takes the place of the one before if its text, stripped, is
    longer or its confidence higher; a confidence of 0 is given back as null."""
    size = lambda x: F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    none = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("confidence"))
    better = lambda a, x: (size(x["text"]) > size(a["text"])) | (x["confidence"] > a["confidence"])
    take = lambda a, x: F.when(better(a, x), F.struct(x["text"].alias("text"), x["confidence"].cast("double").alias("confidence"))).otherwise(a)
    return F.aggregate(attempts, none, take, lambda a: F.struct(F.regexp_replace(a["text"], r"(?U)^\s+|\s+$", "").alias("text"), F.nullif(a["confidence"], F.lit(0.0)).alias("confidence")))


def ocr_decoder(images: Callable[[bytes], list[np.ndarray]], read: Callable[[np.ndarray], tuple[str, list[str]]], methods: tuple[str, ...] = ("adaptive",)):
    """A decoder for `readers.pdf_pages`: each page image is prepared and read by each method, and the best is kept. A method
    that fails on a page is passed over."""
    def decode(content: bytes) -> list[tuple[str, str, float | None]]:
        out = []
        for image in images(content):
            best, sure = "", 0.0
            for method in methods:
                try:
                    text, words = read(prepared(image, method))
                except Exception:  # noqa: BLE001 -- the recogniser's own errors: the next method is tried
                    continue
                mean = confidence_mean(words)
                if len(text.strip()) > len(best.strip()) or mean > sure:
                    best, sure = text, mean
            out.append((best.strip(), "ocr", sure or None))
        return out

    return decode
