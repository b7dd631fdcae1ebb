"""Super-resolution by an ONNX model: one session a worker process, images in tiles.

An ``Upscaler`` is small and is sent to the executors; the model's file must
be readable there (a shared path, or one that Spark distributes). Whatever
fails (no file, no runtime, a wrong shape) is raised, and the pipeline falls
back to edge-adaptive enlargement.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from rasterloom.kernels import enhance as K
from rasterloom.kernels import planes as P
from rasterloom.kernels.planes import Array

# Names of targets and the execution providers they ask for, the best first.
TARGETS = {
    "auto": ["CUDAExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider"],
    "cuda": ["CUDAExecutionProvider", "CPUExecutionProvider"],
    "directml": ["DmlExecutionProvider", "CPUExecutionProvider"],
    "cpu": ["CPUExecutionProvider"],
}

_SESSIONS: dict[tuple, object] = {}


def providers(target: str, available: list[str]) -> tuple[list[str], str]:
    """The providers to load for a target and a label that tells of a fallback."""
    if target not in TARGETS:
        raise ValueError(f"target must be one of {', '.join(TARGETS)}")
    found = [p for p in TARGETS[target] if p in available]
    if not found:
        raise RuntimeError("no execution provider is available")
    first = found[0].removesuffix("ExecutionProvider")
    return found, first if target == "auto" or found[0] == TARGETS[target][0] else f"{first} ({target} isn't available)"


def _session(path: str, target: str):
    import onnxruntime

    names, label = providers(target, onnxruntime.get_available_providers())
    key = (path, tuple(names))
    if key not in _SESSIONS:
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # tasks are the parallelism
        try:
            _SESSIONS[key] = onnxruntime.InferenceSession(path, options, providers=names)
        except Exception as e:  # the runtime has exceptions of its own kinds
            raise RuntimeError(f"{path}: {e}") from e
    return _SESSIONS[key], label


@dataclass(frozen=True)
class Upscaler:
    """Enlarges images by a model of a fixed ``native`` scale; use as ``upscaler`` of the pipeline."""

    path: str
    native: int = 4
    tile: int = 256
    overlap: int = 32
    fast_2x: bool = False
    target: str = "auto"
    label: str = field(default="neural", compare=False)

    def patch(self, a: Array) -> Array:
        """One patch through the model."""
        session, _ = _session(self.path, self.target)
        x = np.ascontiguousarray(a[:, :, ::-1].transpose(2, 0, 1)[None].astype(np.float32) / 255.0)
        y = session.run(None, {session.get_inputs()[0].name: x})[0][0]
        if y.shape != (3, a.shape[0] * self.native, a.shape[1] * self.native):
            raise ValueError(f"the model gave a shape of {y.shape}")
        return (np.clip(y, 0, 1).transpose(1, 2, 0)[:, :, ::-1] * 255.0 + 0.5).astype(np.uint8)

    def __call__(self, a: Array, scale: float) -> Array:
        h, w = a.shape[:2]
        nh, nw = int(np.rint(h * scale)), int(np.rint(w * scale))
        shrink = lambda x, y, z: np.stack([P.byte(P.resize(x[:, :, i], y, z, "area")) for i in range(3)], axis=2)
        if scale <= 1:
            return a.copy() if (nh, nw) == (h, w) else shrink(a, nh, nw)
        if self.fast_2x and scale <= 2:
            a = shrink(a, max(1, round(nh / self.native)), max(1, round(nw / self.native)))
        big = K.tiles(a, self.patch, self.native, self.tile, self.overlap)
        return big if big.shape[:2] == (nh, nw) else K.lanczos(big, nh, nw)
