"""Images and surfaces as tables: NIfTI-1 volumes and GIFTI data, read and written without further libraries."""

from __future__ import annotations

import base64
import gzip
import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: codes of the types of values.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER = 348


def _header(raw: bytes) -> tuple[str, tuple[int, ...], str, int, float, float, list[float]]:
    """Byte order, shape, type, place of the data, slope, intercept and voxel sizes."""
    order = "<" if struct.unpack("<i", raw[:4])[0] == HEADER else ">"
    if struct.unpack(order + "i", raw[:4])[0] != HEADER:
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack(order + "8h", raw[40:56])
    kind = struct.unpack(order + "h", raw[70:72])[0]
    sizes = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    shape = tuple(dim[1 : 1 + dim[0]]) + (1,) * (4 - dim[0])
    return order, shape[:4], order + TYPES[kind], int(offset), slope or 1.0, inter, list(sizes[1:5])


def _unpacked(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def nifti(spark: SparkSession, path: str, mask: DataFrame | None = None) -> DataFrame:
    """(path, t, i, j, k, value) of .nii and .nii.gz images; ``mask`` (i, j, k) keeps its voxels."""
    return voxels(spark.read.format("binaryFile").load(path).select("path", "content"), mask)


def voxels(files: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """The same of images at hand (path, content).

    A file is one task's; its volumes come out one after the other. The header's
    slope and intercept are applied.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                raw = _unpacked(raw)
                _, (ni, nj, nk, nt), kind, offset, slope, inter, _ = _header(raw)
                n = ni * nj * nk
                at = np.arange(n)
                for t in range(nt):
                    v = np.frombuffer(raw, kind, n, offset + t * n * np.dtype(kind).itemsize).astype(float) * slope + inter
                    # the first coordinate runs fastest
                    yield pd.DataFrame({"path": name, "t": t, "i": at % ni, "j": at // ni % nj, "k": at // (ni * nj), "value": v})

    out = files.mapInPandas(run, "path string, t int, i int, j int, k int, value double")
    return out if mask is None else out.join(mask.select("i", "j", "k").distinct(), ["i", "j", "k"], "left_semi").select("path", "t", "i", "j", "k", "value")


def image_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, sizes): extents and voxel sizes of images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(name, [int(x) for x in h[1]], [float(x) for x in h[6]]) for name, raw in zip(pdf["path"], pdf["content"], strict=True) for h in [_header(_unpacked(raw))]]
            yield pd.DataFrame(rows, columns=["path", "shape", "sizes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, shape array<int>, sizes array<double>")


def nifti_bytes(volumes: np.ndarray, sizes: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0), compressed: bool = False) -> bytes:
    """An image of (i, j, k) or (i, j, k, t) values, as 64-bit floats."""
    x = np.asarray(volumes, float)
    dims = (x.ndim, *x.shape, *(1,) * (7 - x.ndim))
    head = bytearray(352)
    head[:4] = struct.pack("<i", HEADER)
    head[40:56] = struct.pack("<8h", *dims)
    head[70:74] = struct.pack("<2h", 64, 64)
    head[76:108] = struct.pack("<8f", 1.0, *sizes[:4], *(1.0,) * (7 - min(len(sizes), 4)))
    head[108:120] = struct.pack("<3f", 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    raw = bytes(head) + x.astype("<f8").tobytes(order="F")
    return gzip.compress(raw) if compressed else raw


def write_nifti(cells: DataFrame, path: str, shape: tuple[int, int, int], sizes: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0), filler: float = 0.0) -> None:
    """Voxels (t, i, j, k, value) to one image, absent ones filled: an image is what one machine holds."""
    pdf = cells.select("t", "i", "j", "k", "value").toPandas()
    out = np.full((*shape, int(pdf["t"].max()) + 1 if len(pdf) else 1), filler)
    out[pdf["i"], pdf["j"], pdf["k"], pdf["t"]] = pdf["value"]
    with open(path, "wb") as f:
        f.write(nifti_bytes(out if out.shape[3] > 1 else out[..., 0], sizes, path.endswith(".gz")))


def image_dataset(spark: SparkSession, path: str, mask: DataFrame | None = None, attributes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells (sample_id, time_coords, feature_id, value and sample attributes by place) and features (feature_id, i, j, k) of one image."""
    from sampleloom.operators.neighborhood import masked_volumes

    head = image_headers(spark, path).first()
    cells, features = masked_volumes(nifti(spark, path).drop("path"), mask, float(head["sizes"][3]) or 1.0)
    if attributes is not None:
        cells = cells.join(attributes, "sample_id", "left")
    return cells, features


#: Fixed values of the surface format: types of values, and the code of arrays of numbers by intent.
SURFACE_TYPES = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8"}


def gifti(spark: SparkSession, path: str) -> DataFrame:
    """(path, array, intent, node, component, value) of GIFTI files: the arrays of a file in order, a row of one for each node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                for a, e in enumerate(ElementTree.fromstring(_unpacked(raw)).iter("DataArray")):
                    text, kind = e.findtext("Data") or "", SURFACE_TYPES[e.get("DataType")]
                    if e.get("Encoding") == "ASCII":
                        v = np.array(text.split(), float)
                    else:
                        body = base64.b64decode(text)
                        body = zlib.decompress(body) if e.get("Encoding") == "GZipBase64Binary" else body
                        v = np.frombuffer(body, (">" if e.get("Endian") == "BigEndian" else "<") + kind).astype(float)
                    n = int(e.get("Dim0"))
                    order = "F" if e.get("ArrayIndexingOrder") == "ColumnMajorOrder" else "C"
                    v = v.reshape((n, -1), order=order)
                    node, part = np.divmod(np.arange(v.size), v.shape[1])
                    yield pd.DataFrame({"path": name, "array": a, "intent": e.get("Intent"), "node": node, "component": part, "value": v.ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, array int, intent string, node int, component int, value double")


def gifti_text(arrays: list[np.ndarray], intent: str = "NIFTI_INTENT_NONE") -> str:
    """A GIFTI file of arrays of numbers, one value or row a node; of a surface that one machine holds."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<GIFTI Version="1.0" NumberOfDataArrays="{len(arrays)}">']
    for x in arrays:
        x = np.atleast_1d(np.asarray(x, float))
        dims = " ".join(f'Dim{i}="{n}"' for i, n in enumerate(x.shape))
        body = base64.b64encode(zlib.compress(x.astype("<f8").tobytes())).decode()
        out.append(f'<DataArray Intent="{intent}" DataType="NIFTI_TYPE_FLOAT64" ArrayIndexingOrder="RowMajorOrder" Dimensionality="{x.ndim}" {dims} Encoding="GZipBase64Binary" Endian="LittleEndian"><Data>{body}</Data></DataArray>')
    return "\n".join([*out, "</GIFTI>"])


def component_results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """A component analysis' folder: its images (component t, i, j, k, value) and time courses (path, values a time point)."""
    from sampleloom.sources.text import numeric_rows

    return nifti(spark, f"{root}/melodic_IC.nii*").drop("path"), numeric_rows(spark, f"{root}/melodic_mix")


def any_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a file by the suffix of its name: images, surfaces, NIML, archives of arrays, tables."""
    from sampleloom.dataset import Dataset
    from sampleloom.sources import text

    name = path.lower().removesuffix(".gz")
    if name.endswith(".nii"):
        return nifti(spark, path)
    if name.endswith(".gii"):
        return gifti(spark, path)
    if name.endswith(".niml.dset") or name.endswith(".niml"):
        return text.niml_datasets(spark, path)
    if name.endswith(".npz"):
        return Dataset.from_npz(spark, path).samples
    if name.endswith((".csv", ".tsv", ".txt")):
        return text.inferred(spark, path, "\t" if name.endswith(".tsv") else ",")
    raise ValueError(f"unknown kind of file: {path}")
