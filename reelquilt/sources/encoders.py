"""An encoder of images and texts from model files of the user's own: ONNX graphs and a tokenizer."""

from __future__ import annotations

import functools
import os
import subprocess
from collections.abc import Callable

import numpy as np

from reelquilt.sources.media import local_path

# Mean and deviation of the channels that published dual encoders expect, and their context length.
CHANNEL_MEAN = (0.48145466, 0.4578275, 0.40821073)
CHANNEL_STD = (0.26862954, 0.26130258, 0.27577711)
CONTEXT = 77


def decode_image(path: str, size: int) -> np.ndarray:
    """An image's middle square at ``size`` as (size, size, 3) bytes, decoded by ffmpeg; raises if it can't be read."""
    fit = f"scale={size}:{size}:force_original_aspect_ratio=increase:flags=bicubic,crop={size}:{size}"
    done = subprocess.run(["ffmpeg", "-v", "error", "-i", local_path(path), "-vf", fit, "-frames:v", "1", "-f", "rawvideo", "-pix_fmt", "rgb24", "-"], capture_output=True)
    if done.returncode or len(done.stdout) != size * size * 3:
        raise ValueError(f"{path} can't be decoded: {done.stderr.decode(errors='replace')[-200:]}")
    return np.frombuffer(done.stdout, dtype=np.uint8).reshape(size, size, 3)


class OnnxEncoder:
    """A ``FeatureProvider``: ``image_model`` takes (n, 3, size, size) floats, ``text_model`` (n, context) token numbers.

    Models are loaded once per Python worker, when they are first used.  Texts longer than the context keep its end token.
    An image that can't be decoded has no feature.
    """

    def __init__(self, image_model: str, text_model: str, tokenizer: str, *, size: int = 224, context: int = CONTEXT, decode: Callable[[str, int], np.ndarray] = decode_image):
        self.files = {"image": image_model, "text": text_model}
        self.tokenizer_file, self.size, self.context, self.decode = tokenizer, size, context, decode
        self.sessions: dict[str, object] = {}

    def _run(self, kind: str, values: np.ndarray) -> np.ndarray:
        if kind not in self.sessions:
            import onnxruntime

            self.sessions[kind] = onnxruntime.InferenceSession(self.files[kind])
        session = self.sessions[kind]
        return np.asarray(session.run(None, {session.get_inputs()[0].name: values})[0], dtype=float)

    def encode_images(self, paths: list[str]) -> list[np.ndarray | None]:
        pixels: dict[int, np.ndarray] = {}
        for i, path in enumerate(paths):
            try:
                pixels[i] = (self.decode(path, self.size) / 255.0 - CHANNEL_MEAN) / CHANNEL_STD
            except (OSError, ValueError):
                continue
        found = self._run("image", np.stack([x.transpose(2, 0, 1) for x in pixels.values()]).astype(np.float32)) if pixels else []
        features = dict(zip(pixels, found))
        return [features.get(i) for i in range(len(paths))]

    def tokens(self, texts: list[str]) -> np.ndarray:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.tokenizer_file)
        out = np.zeros((len(texts), self.context), dtype=np.int64)
        for row, text in zip(out, texts):
            ids = own.encode(text).ids
            ids = ids if len(ids) <= self.context else [*ids[: self.context - 1], ids[-1]]
            row[: len(ids)] = ids
        return out

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        return self._run("text", self.tokens(texts)) if texts else np.zeros((0, 1))


def from_folder(folder: str, **options) -> Callable[[], OnnxEncoder]:
    """Factory of the encoder in a folder: ``image.onnx``, ``text.onnx`` and ``tokenizer.json``."""
    return functools.partial(OnnxEncoder, *(os.path.join(folder, f) for f in ("image.onnx", "text.onnx", "tokenizer.json")), **options)
