"""Archives made of documents, to have something to unpack."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents in one archive at most, by id.
IN_ONE = 256


def _zip(names: list[str], contents: list[bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in zip(names, contents, strict=True):
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def _tar_zst(names: list[str], contents: list[bytes]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "zstd") as z, tarfile.open(fileobj=z, mode="w|") as t:
        for name, content in zip(names, contents, strict=True):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue().to_pybytes()


def _image(names: list[str], contents: list[bytes]) -> bytes:
    """A zip behind a program that names magic numbers of other formats."""
    return b"\x7fELF" + bytes(200) + b"looks for hsqs, sqsh, CD001 or PK\x03\x04" + bytes(300) + _zip(names, contents)


def _deb(names: list[str], contents: list[bytes]) -> bytes:
    """A package: its version, and the files in a tar under zstd."""
    parts = (("debian-binary", b"2.0\n"), ("data.tar.zst", _tar_zst(names, contents)))
    return b"!<arch>\n" + b"".join(b"%-16s%-12s%-6s%-6s%-8s%-10d`\n" % (n.encode(), b"0", b"0", b"0", b"100644", len(c)) + c + b"\n" * (len(c) % 2) for n, c in parts)


#: How archives are made, by the ending of their names.
MAKERS = {"zip": _zip, "tar.zst": _tar_zst, "appimage": _image, "deb": _deb}


def packed(docs: DataFrame, kind: str = "zip") -> DataFrame:
    """path, content: archives of a kind, in one another, of the documents, by source and block of ids."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, make = pdf.sort_values("doc_id"), MAKERS[kind]
        inner = make([f"{i}.txt" for i in pdf["doc_id"]], [(t or "").encode() for t in pdf["text"]])
        path = f"{pdf['source'].iloc[0]}-{pdf['block'].iloc[0]}.{kind}"
        return pd.DataFrame({"path": [path], "content": [make([f"inner.{kind}"], [inner])]})

    blocks = docs.select("doc_id", "source", "text", F.floor(F.col("doc_id") / IN_ONE).alias("block"))
    return blocks.groupBy("source", "block").applyInPandas(pack, "path string, content binary")
