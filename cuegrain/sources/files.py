"""Files read by ranges, on any file system that pyarrow opens by its address; used in tasks and while sources are planned."""

from __future__ import annotations

from pyarrow import fs


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a plain path."""
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def address(base: str, path: str) -> str:
    """The address of a path that a listing below ``base`` gave."""
    kind, mark, _ = base.partition("://")
    if mark and kind != "file":
        return f"{kind}://{path}"
    return f"file://{path}" if base.startswith("file:") else path


def listed(base: str, suffix: str | tuple[str, ...]) -> list[tuple[str, int]]:
    """(address, size) of the files below a folder whose names end with ``suffix`` (or one of them), or of the one file; hidden ones are left out."""
    system, root = opened(base)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[0] in "._" for x in p[len(root) :].split("/") if x)
    return sorted((address(base, x.path), x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffix) and not hidden(x.path))


def folders(base: str) -> list[str]:
    """Addresses of the folders right below a folder; hidden ones are left out."""
    system, root = opened(base)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(address(base, x.path) for x in found if x.type == fs.FileType.Directory and x.base_name[0] not in "._")


class Ranges:
    """One file: ``at`` reads a range, small ones through one block that is kept. ``spent`` counts the bytes that were read."""

    def __init__(self, path: str, block: int = 4096):
        system, inner = opened(path)
        self.file = system.open_input_file(inner)
        self.size, self.block, self.spent = self.file.size(), block, 0
        self.first, self.held = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """At most n bytes from a place on; fewer at the end of the file."""
        if self.first <= place and place + n <= self.first + len(self.held):
            return self.held[place - self.first : place - self.first + n]
        data = self.file.read_at(max(0, min(max(n, self.block), self.size - place)), min(place, self.size))
        self.spent += len(data)
        if n < self.block:
            self.first, self.held = place, data
        return data[:n]

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *error) -> None:
        self.close()
