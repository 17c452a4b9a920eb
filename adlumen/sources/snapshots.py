"""Numbered folders of which those count that Spark wrote as a whole."""

from __future__ import annotations

from pyarrow import fs

from adlumen.session import arrow_folder


def numbered(path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix><number>`` under ``path``, ascending; none if there is no such path."""
    system, root = arrow_folder(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    numbers = [f.base_name.removeprefix(prefix) for f in found if f.base_name.startswith(prefix)]
    return sorted(int(n) for n in numbers if n.isdigit())


def complete(path: str, prefix: str) -> list[int]:
    """Those of them whose job was committed, as its ``_SUCCESS`` file tells."""
    system, root = arrow_folder(path)
    numbers = numbered(path, prefix)
    marks = system.get_file_info([f"{root}/{prefix}{n}/_SUCCESS" for n in numbers])
    return [n for n, mark in zip(numbers, marks) if mark.type == fs.FileType.File]


def removed(path: str, folder: str) -> None:
    system, root = arrow_folder(path)
    system.delete_dir(f"{root}/{folder}")
