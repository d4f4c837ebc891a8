"""Errors of this library."""


class MeshwrightError(ValueError):
    """Base of the library's errors."""


class ImageDirectoryError(MeshwrightError):
    """A folder holds no usable images."""

    def __init__(self, directory: str) -> None:
        super().__init__(f"no images found in {directory}")
        self.directory = directory


class StructuralElementError(MeshwrightError):
    """Structuring elements are not given as a list of radii."""


class InvalidArgumentsError(MeshwrightError):
    """Options exclude each other or are out of range."""
