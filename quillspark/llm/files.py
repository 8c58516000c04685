"""Files that tasks write next to Spark's own tables."""

from __future__ import annotations

from pyarrow import fs as pafs


def commit(fs: pafs.FileSystem, temp: str, target: str) -> None:
    """Give a whole file its name.

    Attempts of one task write the same bytes, so a name that is taken already stands for the same
    file and stays; it is never removed, whatever attempt is ended when.
    """
    if fs.get_file_info(target).type == pafs.FileType.NotFound:
        try:
            fs.move(temp, target)
            return
        except OSError:
            if fs.get_file_info(target).type == pafs.FileType.NotFound:
                raise
    if fs.get_file_info(temp).type != pafs.FileType.NotFound:
        fs.delete_file(temp)
