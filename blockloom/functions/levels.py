"""Planning of frames: superblocks, levels, bounds and rates, as columns and plain numbers.

All columns are built from Spark's own functions, so they fold, push down and compile.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
BLOCK_ELEMENTS = 256
ROW_BYTES = 16
SUPERBLOCK_BYTES = 131072
MAX_SUPERBLOCK_BYTES = 16777215
FRAME_HEADER_BYTES = 12
RECORD_HEADER_BYTES = 4
BOUND_UNIT_BYTES = 65792
CUSTOM_SHIFT = 255
#: MB/s that each level keeps up with, fastest last: (level, rate).
RATES = ((9, 1), (8, 5), (7, 7), (6, 9), (5, 20), (4, 40), (3, 60), (2, 230), (1, 300))
#: Level guessed for a wanted rate below each MB/s; 2 beyond.
GUESSES = ((10, 9), (40, 8), (100, 7), (200, 6), (400, 5))


class CodecError(ValueError):
    """A value that the format cannot hold."""


class InvalidWidth(CodecError):
    pass


class InvalidParameter(CodecError):
    pass


@dataclass(frozen=True)
class CodecConfig:
    """Settings of a superblock plan; with_() gives changed copies."""

    level: int = 1
    shift: int | None = None

    def with_(self, **changes) -> "CodecConfig":
        new = replace(self, **changes)
        if new.shift is not None and not 0 <= new.shift < 16:
            raise InvalidParameter(f"a block shift of {new.shift}")
        return replace(new, level=min(9, max(0, new.level)))

    def superblock_bytes(self, width: int, total: int | None = None) -> int:
        if not 1 <= width < MAX_SUPERBLOCK_BYTES // BLOCK_ELEMENTS:
            raise InvalidWidth(f"an element width of {width}")
        unit = width * BLOCK_ELEMENTS
        if self.shift is not None:
            size = unit << self.shift
        else:
            size = max(unit, SUPERBLOCK_BYTES // unit * unit)
            if total is None or total > size:
                size <<= level_shift(self.level)
        if size > MAX_SUPERBLOCK_BYTES:
            raise InvalidParameter(f"a superblock of {size} bytes")
        return size


def level_shift(level: int) -> int:
    return 0 if level < 1 else (level - 1) // 2


def block_bytes(width: Column) -> Column:
    return width * BLOCK_ELEMENTS


def default_superblock(width: Column) -> Column:
    """The largest multiple of a block within SUPERBLOCK_BYTES, at least one block."""
    unit = block_bytes(width)
    return F.greatest(unit, F.floor(F.lit(SUPERBLOCK_BYTES) / unit) * unit).cast("bigint")


def shift_of(level: Column, total: Column, width: Column) -> Column:
    grows = (level >= 1) & (total > default_superblock(width))
    return F.when(grows, F.floor((level - 1) / 2)).otherwise(0).cast("bigint")


def superblock(level: Column, total: Column, width: Column) -> Column:
    return (default_superblock(width) * F.pow(F.lit(2), shift_of(level, total, width))).cast("bigint")


def bound(total: Column) -> Column:
    """Most bytes that a frame of total bytes takes."""
    records = F.greatest(F.lit(1), F.ceil(total / BOUND_UNIT_BYTES))
    return (FRAME_HEADER_BYTES + records * RECORD_HEADER_BYTES + total).cast("bigint")


def entropy_level(level: Column, width: Column) -> Column:
    """zstd setting 0 to 9 of a level: none for level 0, and for level 1 of wide elements."""
    wide = F.when(level <= 1, 0).when(level - 1 >= 4, level).otherwise(level - 1)
    return F.when(level <= 0, 0).when(width == 1, level).otherwise(wide).cast("bigint")


def zstd_level(setting: Column, maximum: int = 22) -> Column:
    return F.when(setting < 1, 1).when(setting > 8, maximum).otherwise(setting * 2 - 1).cast("bigint")


def varint_bytes(distance: Column) -> Column:
    return F.when(distance < 128, 1).otherwise(2).cast("bigint")


def word_bytes(width: Column) -> Column:
    """Bytes of the words that matches are looked for in; null where none are."""
    return (
        F.when(width > 512, None)
        .when(width % 8 == 0, 8)
        .when((width <= 2) | (width % 4 == 0), 4)
        .when(width % 6 == 0, 6)
        .when(width % 3 == 0, 3)
        .cast("bigint")
    )
