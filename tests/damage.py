"""Damages files on purpose."""

from pathlib import Path


def flip(path: str, offset: int = -8, mask: int = 0x55) -> None:
    """Changes the byte at offset (from the end if negative) and removes the checksum file beside, as a disk would."""
    file = Path(path.removeprefix("file:"))
    data = bytearray(file.read_bytes())
    data[offset] ^= mask or 1
    file.write_bytes(data)
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
