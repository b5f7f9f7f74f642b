"""Graphs of array operations that ``onnxruntime`` runs in compiled code, several times faster than numpy.

Graphs are written as ONNX protocol buffers by hand, since the library reads them but has no way to make them.
"""

from __future__ import annotations

from importlib.util import find_spec

import numpy as np

_TYPES = {"float32": 1, "int32": 6, "int64": 7}


def available() -> bool:
    return find_spec("onnxruntime") is not None


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _attribute(name: str, value: int | float | str | list[int]) -> bytes:
    if isinstance(value, str):
        return _field(1, name) + _field(4, value) + _field(20, 3)
    if isinstance(value, float):
        return _field(1, name) + _field(2, value) + _field(20, 1)
    if isinstance(value, int):
        return _field(1, name) + _field(3, value) + _field(20, 2)
    return _field(1, name) + b"".join(_field(8, v) for v in value) + _field(20, 7)


class Graph:
    """A graph that is put together node by node; values are known by their names."""

    def __init__(self) -> None:
        self.body, self.made, self.outputs = b"", 0, []

    def input(self, name: str, kind: str, rank: int) -> str:
        shape = b"".join(_field(1, _field(2, f"{name}{i}")) for i in range(rank))
        self.body += _field(11, _field(1, name) + _field(2, _field(1, _field(1, _TYPES[kind]) + _field(2, shape))))
        return name

    def constant(self, value: np.ndarray) -> str:
        self.made += 1
        name = f"c{self.made}"
        dims = b"".join(_field(1, int(n)) for n in value.shape)
        self.body += _field(5, dims + _field(2, _TYPES[str(value.dtype)]) + _field(8, name) + _field(9, np.ascontiguousarray(value).tobytes()))
        return name

    def shape(self, *sizes: int) -> str:
        return self.constant(np.array(sizes, np.int64))

    def __call__(self, op: str, *inputs: str, outputs: int = 1, domain: str = "", **attributes):
        names = [f"v{self.made + i + 1}" for i in range(outputs)]
        self.made += outputs
        node = b"".join(_field(1, x) for x in inputs) + b"".join(_field(2, x) for x in names) + _field(4, op)
        node += b"".join(_field(5, _attribute(k, v)) for k, v in attributes.items()) + (_field(7, domain) if domain else b"")
        self.body += _field(1, node)
        return names[0] if outputs == 1 else names

    def product(self, a: str, b: str, a_turned: int = 0, b_turned: int = 0, alpha: float = 1.0) -> str:
        """The matrix product of the last two axes, of either or both of them turned."""
        return self("FusedMatMul", a, b, domain="com.microsoft", transA=a_turned, transB=b_turned, alpha=alpha)

    def output(self, *names: str) -> None:
        self.outputs += names

    def session(self):
        """A function from inputs by name to outputs, which runs in the thread that calls it: a task has one core."""
        import onnxruntime

        outs = b"".join(_field(12, _field(1, name)) for name in self.outputs)
        sets = _field(8, _field(2, 18)) + _field(8, _field(1, "com.microsoft") + _field(2, 1))
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.enable_mem_pattern = False  # shapes differ from call to call
        options.log_severity_level = 3
        found = onnxruntime.InferenceSession(_field(1, 8) + sets + _field(7, self.body + _field(2, "graph") + outs), options, providers=["CPUExecutionProvider"])
        return lambda **inputs: found.run(self.outputs, inputs)
