"""Models that turn texts into vectors: a protocol, one over HTTP, and one that needs no model."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np

from ..schema import DataError
from ..sources.remote import fetch, load, rgb

PROVIDERS = {"vllm": "text", "sentence-transformer": "text", "huggingface-image": "image", "open-clip": "multimodal"}


class Embedder(Protocol):
    dims: int
    modality: str

    def __call__(self, values: list[str]) -> np.ndarray: ...


def shaped(x: np.ndarray, dims: int | None = None, normalize: bool = True) -> np.ndarray:
    """The first dims values, then length 1; a zero vector stays."""
    x = x[:, :dims] if dims else x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n) if normalize else x


@dataclass
class Hashing:
    """Words hashed to signed dimensions; the same everywhere, with no meaning beyond shared words."""

    dims: int = 64
    modality: str = "text"

    def __call__(self, values: list[str]) -> np.ndarray:
        x = np.zeros((len(values), self.dims), np.float32)
        for k, v in enumerate(values):
            for w in v.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                x[k, int.from_bytes(h[:4]) % self.dims] += 1 if h[4] & 1 else -1
        return shaped(x).astype(np.float32)


@dataclass
class Served:
    """A server with an embeddings endpoint; texts in batches, longest first, so that padding is short. dims: of the model, asked of the server if not given."""

    url: str
    model: str
    dims: int | None = None
    truncate: int | None = None
    batch: int = 16
    modality: str = "text"

    def _post(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": texts} | ({"truncate_prompt_tokens": self.truncate} if self.truncate else {})
        answer = fetch(self.url + "/v1/embeddings", {"Content-Type": "application/json"}, data=json.dumps(body).encode(), timeout=300)
        return [row["embedding"] for row in json.loads(answer)["data"]]

    def models(self) -> list[str]:
        """Names of the models that the server has."""
        return [m["id"] for m in json.loads(fetch(self.url + "/v1/models"))["data"]]

    def probe(self) -> Served:
        """The same with its dimensions, by one text; an unknown model is an error."""
        if self.model not in self.models():
            raise DataError(f"the server has no model {self.model}")
        return self if self.dims else replace(self, dims=len(self._post(["test"])[0]))

    def __call__(self, values: list[str]) -> np.ndarray:
        out: np.ndarray | None = None
        order = sorted(range(len(values)), key=lambda k: -len(values[k]))
        for at in range(0, len(order), self.batch):
            part = order[at : at + self.batch]
            rows = shaped(np.array(self._post([values[k] for k in part]), np.float32), self.dims)
            out = np.zeros((len(values), rows.shape[1]), np.float32) if out is None else out
            out[part] = rows
        return np.zeros((0, self.dims or 0), np.float32) if out is None else out


def _library(name: str):
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise DataError(f"this model needs the library {name}") from e


class _Local:
    """A model that each Python worker loads once."""

    library = ""
    modality = "text"

    def __init__(self, name: str, dims: int | None = None, device: str = "cpu", batch: int = 16) -> None:
        self.name, self.dims, self.device, self.batch = name, dims, device, batch

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_loaded"}

    def _model(self):
        if "_loaded" not in self.__dict__:
            self._loaded = self._load(_library(self.library))
        return self._loaded

    def _batches(self, values: list, by=len) -> np.ndarray:
        """Values in batches, the largest first; rows in the order of the values."""
        order = sorted(range(len(values)), key=lambda k: -by(values[k]))
        rows = [self._embed([values[k] for k in order[at : at + self.batch]]) for at in range(0, len(order), self.batch)]
        out = np.concatenate(rows) if rows else np.zeros((0, self.dims or 0), np.float32)
        back = np.empty_like(out)
        back[order] = out
        # Cut after it was made as long as one, and not made so again.
        return back[:, : self.dims] if self.dims else back


class Sentences(_Local):
    """A sentence transformer."""

    library = "sentence_transformers"

    def _load(self, lib):
        return lib.SentenceTransformer(self.name, device=self.device)

    def _embed(self, texts: list[str]) -> np.ndarray:
        return shaped(np.asarray(self._model().encode(texts, batch_size=self.batch, convert_to_numpy=True), np.float32))

    def __call__(self, values: list[str]) -> np.ndarray:
        return self._batches(values)


class Images(_Local):
    """An image model: the state of the class token. Values are addresses, or base64 of images."""

    library, modality = "transformers", "image"

    def _load(self, lib):
        return lib.AutoImageProcessor.from_pretrained(self.name), lib.AutoModel.from_pretrained(self.name).to(self.device)

    def _embed(self, images: list[np.ndarray]) -> np.ndarray:
        torch = _library("torch")
        processor, model = self._model()
        with torch.no_grad():
            out = model(**processor(images=images, return_tensors="pt").to(self.device)).last_hidden_state[:, 0]
        return shaped(out.cpu().numpy().astype(np.float32))

    def __call__(self, values: list[str]) -> np.ndarray:
        return self._batches([pixels(v) for v in values], by=np.size)


class Clip(_Local):
    """A model of texts and images in one space; a value is an image if it is the address of one, or base64 of one."""

    library, modality = "open_clip", "multimodal"

    def _load(self, lib):
        model, _, preprocess = lib.create_model_and_transforms(self.name, device=self.device)
        return model.eval(), preprocess, lib.get_tokenizer(self.name)

    def _embed(self, values: list) -> np.ndarray:
        torch = _library("torch")
        model, preprocess, tokenize = self._model()
        with torch.no_grad():
            if isinstance(values[0], str):
                out = model.encode_text(tokenize(values).to(self.device))
            else:
                from PIL import Image

                out = model.encode_image(torch.stack([preprocess(Image.fromarray(v)) for v in values]).to(self.device))
        return shaped(out.cpu().numpy().astype(np.float32))

    def __call__(self, values: list[str]) -> np.ndarray:
        images = [k for k, v in enumerate(values) if looks_like_image(v)]
        texts = [k for k in range(len(values)) if k not in set(images)]
        parts = [(k, self._batches(v)) for k, v in ((texts, [values[k] for k in texts]), (images, [pixels(values[k]) for k in images])) if k]
        out = np.zeros((len(values), parts[0][1].shape[1] if parts else self.dims or 0), np.float32)
        for k, rows in parts:
            out[k] = rows
        return out


def looks_like_image(value: str) -> bool:
    return value.startswith(("http://", "https://", "file://", "data:image/", "/9j/", "iVBOR", "R0lGOD", "UklGR"))


def pixels(value: str) -> np.ndarray:
    """Height x width x 3 array of an image's address, or of its base64."""
    if value.startswith("data:image/"):
        return rgb(value.partition(",")[2])
    return rgb(load(value)) if "://" in value else rgb(value)
