"""Entropy coders and packers by name, so that others can be put in."""

from __future__ import annotations

from typing import Protocol

import numpy as np

from loomspan.codec import bits, rans


class Coder(Protocol):
    """Places of symbols in a model to bytes and back."""

    def encode(self, places: np.ndarray, model: rans.Model) -> bytes: ...

    def decode(self, data: bytes, n: int, model: rans.Model) -> np.ndarray: ...


class Packer(Protocol):
    """Integers of a fixed width to bytes and back."""

    def pack(self, values: np.ndarray, width: int) -> bytes: ...

    def unpack(self, data: bytes, width: int, n: int, signed: bool) -> np.ndarray: ...


class Lanes:
    def encode(self, places: np.ndarray, model: rans.Model) -> bytes:
        return rans.encode(places, model)

    def decode(self, data: bytes, n: int, model: rans.Model) -> np.ndarray:
        return rans.decode(data, model)


class Single:
    def encode(self, places: np.ndarray, model: rans.Model) -> bytes:
        return rans.encode_single(places, model)

    def decode(self, data: bytes, n: int, model: rans.Model) -> np.ndarray:
        return rans.decode_single(data, n, model)


class Planes:
    def pack(self, values: np.ndarray, width: int) -> bytes:
        return bits.pack(values, width)

    def unpack(self, data: bytes, width: int, n: int, signed: bool) -> np.ndarray:
        return bits.unpack(data, width, n, signed)


CODERS: dict[str, Coder] = {"lanes": Lanes(), "single": Single()}
PACKERS: dict[str, Packer] = {"planes": Planes()}


def register(kind: dict, name: str, backend: object) -> None:
    """Puts a coder or packer under a name. Workers must register it as well, as by importing a module that does."""
    kind[name] = backend


def get(kind: dict, name: str) -> object:
    try:
        return kind[name]
    except KeyError:
        raise ValueError(f"no such backend: {name}; there are {sorted(kind)}") from None
