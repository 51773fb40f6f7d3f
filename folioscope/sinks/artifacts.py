"""Artifacts of documents below one root: immutable, written whole, and unable to leave the root.

For single objects on the driver or in an adapter; tables go through Spark's
own writers.  Any store that Arrow can open works: a local folder or an object
store's URI.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

from pyarrow import fs

_COMPONENT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")
SCHEME = "artifact://"


class ArtifactError(ValueError):
    """An unsafe name, a missing artifact, or one that is there already."""


def safe_parts(name: str) -> list[str]:
    """The parts of a relative name; raises for anything that could lead elsewhere."""
    parts = name.replace("\\", "/").split("/")
    if name.startswith(("/", "\\")) or any(p in (".", "..") or not _COMPONENT.fullmatch(p) for p in parts):
        raise ArtifactError(f"unsafe artifact name: {name!r}")
    return parts


def parse_uri(uri: str) -> tuple[str, str]:
    """(document, name) of an artifact URI."""
    if not uri.startswith(SCHEME):
        raise ArtifactError("not an artifact URI")
    document, _, name = uri[len(SCHEME) :].partition("/")
    safe_parts(document)
    return document, "/".join(safe_parts(name))


@dataclass(frozen=True)
class Artifact:
    uri: str
    sha256: str
    byte_size: int


class ArtifactStore:
    """Put, get, list and delete below a root (a folder or a store's URI)."""

    def __init__(self, root: str):
        self.fs, path = fs.FileSystem.from_uri(root)
        self.root = path.rstrip("/")
        self.base = root.rstrip("/")

    def _path(self, document: str, name: str) -> str:
        return "/".join([self.root, *safe_parts(document)[:1], *safe_parts(name)])

    def exists(self, document: str, name: str) -> bool:
        return self.fs.get_file_info(self._path(document, name)).type == fs.FileType.File

    def put(self, document: str, name: str, data: bytes, overwrite: bool = False) -> Artifact:
        """Writes beside the target and moves it there, so that no reader meets half of it."""
        if not overwrite and self.exists(document, name):
            raise ArtifactError(f"artifact exists: {name}")
        path = self._path(document, name)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(aside, compression=None) as out:
            out.write(data)
        self.fs.move(aside, path)
        return Artifact(f"{SCHEME}{document}/{'/'.join(safe_parts(name))}", hashlib.sha256(data).hexdigest(), len(data))

    def get(self, document: str, name: str) -> bytes:
        if not self.exists(document, name):
            raise ArtifactError(f"no such artifact: {name}")
        with self.fs.open_input_stream(self._path(document, name), compression=None) as f:
            return f.read()

    def read_uri(self, uri: str) -> bytes:
        """By artifact URI, or by the store's own URI below its root: exports and images use one resolver."""
        if uri.startswith(SCHEME):
            return self.get(*parse_uri(uri))
        if not uri.startswith(f"{self.base}/"):
            raise ArtifactError("URI is not below this store")
        document, _, name = uri[len(self.base) + 1 :].partition("/")
        return self.get(document, name)

    def delete_document(self, document: str) -> int:
        """Deletes all artifacts of a document; how many there were."""
        path = "/".join([self.root, *safe_parts(document)[:1]])
        found = self.fs.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        n = sum(f.type == fs.FileType.File for f in found)
        if found:
            self.fs.delete_dir(path)
        return n


def page_folder(page: int) -> str:
    if page < 1:
        raise ArtifactError("pages count from 1")
    return f"pages/page_{page:04d}"


def render_name(page: int, dpi: int) -> str:
    return f"{page_folder(page)}/original_render_{dpi}dpi.png"


def crop_name(page: int, crop: str, extension: str = "png") -> str:
    return f"{page_folder(page)}/crops/{safe_parts(crop)[0]}.{safe_parts(extension)[0]}"


def review_name(page: int, review: str) -> str:
    return f"{page_folder(page)}/reviews/{safe_parts(review)[0]}.json"
