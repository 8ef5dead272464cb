"""Contents by file name: encoders and decoders by extension, also stacked (``.json.gz``: unpacked first, then parsed)."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Codec:
    encode: Callable
    decode: Callable
    #: Its output is bytes that the next extension tells about.
    wraps: bool = False


def _save(writer: Callable) -> Callable:
    def encode(value) -> bytes:
        out = io.BytesIO()
        writer(out, value)
        return out.getvalue()

    return encode


class Codecs:
    """Codecs by extension in lower case. strict: a name without a codec is an error, otherwise bytes stay as they are. Pickles
    run code when they are read, so they are off unless asked for."""

    def __init__(self, strict: bool = True, pickles: bool = False):
        self.strict, self.known = strict, {}
        self.register([".json"], lambda x: json.dumps(x).encode(), lambda b: json.loads(b))
        self.register([".npy"], _save(lambda f, x: np.save(f, x, allow_pickle=False)), lambda b: np.load(io.BytesIO(b), allow_pickle=False))
        self.register([".npz"], _save(lambda f, x: np.savez(f, **x)), lambda b: dict(np.load(io.BytesIO(b), allow_pickle=False)))
        self.register([".gz", ".gzip"], lambda b: gzip.compress(b, 9, mtime=0), gzip.decompress, wraps=True)
        self.register([".xz", ".lzma"], lzma.compress, lzma.decompress, wraps=True)
        self.register([".bz2"], lambda b: bz2.compress(b, 9), bz2.decompress, wraps=True)
        if pickles:
            self.register([".pkl", ".pickle"], pickle.dumps, pickle.loads)
        try:
            import msgpack
        except ImportError:
            pass
        else:
            self.register([".msgpack"], msgpack.packb, msgpack.unpackb)
        try:
            from PIL import Image
        except ImportError:
            pass
        else:
            for kind in ("png", "jpeg", "bmp", "gif", "tiff", "webp"):
                ends = {"jpeg": [".jpg", ".jpeg"], "tiff": [".tif", ".tiff"]}.get(kind, [f".{kind}"])
                self.register(ends, _save(lambda f, x, k=kind: Image.fromarray(x).save(f, k)), lambda b: np.asarray(Image.open(io.BytesIO(b))))

    def register(self, extensions: list[str], encode: Callable, decode: Callable, wraps: bool = False) -> None:
        self.known.update({e.lower(): Codec(encode, decode, wraps) for e in extensions})

    def unregister(self, extensions: list[str]) -> None:
        for e in extensions:
            self.known.pop(e.lower(), None)

    def _of(self, name: str) -> tuple[str, Codec | None]:
        stem, dot, end = name.rpartition(".")
        codec = self.known.get(f".{end.lower()}") if dot and stem else None
        if codec is None and self.strict:
            raise ValueError(f"no codec for {name!r}")
        return stem, codec

    def encode(self, path: str, value) -> bytes:
        stem, codec = self._of(path.rpartition("/")[2])
        if codec is None:
            return value
        if codec.wraps and not isinstance(value, bytes):
            value = self.encode(stem, value)
        return codec.encode(value)

    def decode(self, path: str, data: bytes):
        stem, codec = self._of(path.rpartition("/")[2])
        if codec is None:
            return data
        out = codec.decode(data)
        inner = stem.rpartition(".")[2].lower()
        return self.decode(stem, out) if codec.wraps and "." in stem and f".{inner}" in self.known else out


def arrays(contents, codecs: Codecs | None = None):
    """path, shape, dtype, values of the ``.npy`` files (also packed) among contents (path, content): decoded in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):
        own = codecs or Codecs()
        for batch in batches:
            found = [own.decode(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(x.shape) for x in found], pa.list_(pa.int64())), pa.array([str(x.dtype) for x in found]), pa.array([x.astype(float).ravel().tolist() for x in found], pa.list_(pa.float64()))], ["path", "shape", "dtype", "values"])

    rows = contents.filter(F.lower("path").rlike(r"\.npy(\.(gz|gzip|xz|lzma|bz2))?\z")).select("path", "content")
    return rows.mapInArrow(run, "path string, shape array<long>, dtype string, values array<double>")


def json_values(contents):
    """path and value (a variant) of the plain ``.json`` files among contents, parsed in Spark itself."""
    from pyspark.sql import functions as F

    return contents.filter(F.lower("path").endswith(".json")).select("path", F.parse_json(F.decode("content", "UTF-8")).alias("value"))
