"""Files that tasks write and read in the shared folder, by whatever store its URI names."""

from contextlib import contextmanager

from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


@contextmanager
def writing(path: str):
    """A binary stream to a new file."""
    store, name = _place(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name, compression=None) as out:
        yield out


@contextmanager
def reading(path: str):
    """A binary file that can be sought."""
    store, name = _place(path)
    with store.open_input_file(name) as file:
        yield file
