"""Errors of the library."""


class GridloomError(Exception):
    """Root of all errors raised here."""


class ResampleNeeded(GridloomError):
    """Inputs differ in pixel grid and no reference grid says what to resample to."""


class NoOverlap(GridloomError):
    """Grids do not intersect."""


class RatMismatch(GridloomError):
    """Attribute tables have different row counts."""


class RatBlockLength(GridloomError):
    """Columns returned for a block of an attribute table differ in length."""


class ArrayShape(GridloomError):
    """A block function returned an array of the wrong shape."""


class AttributeColumn(GridloomError):
    """An attribute table has no such column."""


class SinglePassImpossible(GridloomError):
    """A statistic was asked for in the writing pass and cannot be had there."""


class FileOpen(GridloomError):
    """An input can be read neither as raster nor as vector."""


class BadOption(GridloomError):
    """An unknown option, image name or combination of options."""
