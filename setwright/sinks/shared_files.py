"""File access from tasks, on whatever file system the target address names."""

from __future__ import annotations

import re

from pyarrow import fs


def open_base(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path within it."""
    local = re.match(r"^file:/+(.*)$", path)
    if local:
        return fs.LocalFileSystem(), "/" + local.group(1)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_below(filesystem: fs.FileSystem, base: str, suffix: str) -> list[fs.FileInfo]:
    """Visible files below ``base``, in a fixed order."""
    found = filesystem.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted(
        (
            f
            for f in found
            if f.type == fs.FileType.File
            and f.path.endswith(suffix)
            and not any(p.startswith(("_", ".")) for p in f.path[len(base) :].split("/"))
        ),
        key=lambda f: f.path,
    )
