"""Base64 payloads of command lines: bytes, perhaps compressed, in one of a few encodings."""

from __future__ import annotations

import base64
import gzip
import itertools
import re
import zlib
from collections.abc import Callable, Iterator

# Encodings by priority, and characters that only wrong decoding gives.
ENCODINGS = ("utf-16-le", "utf-8", "cp1252", "latin-1")
WRONG = re.compile("[謟␊獡摤獦晤㐱㴠∠]")
CONTROLS = re.compile("[\x01-\x08\x0b\x0c\x0e-\x1f]")
MOST_CONTROLS, LEAST_READABLE = 0.02, 0.5
#: Bytes as they are, as raw deflate, as gzip.
PACKINGS: tuple[Callable[[bytes], bytes], ...] = (bytes, lambda x: zlib.decompress(x, -15), gzip.decompress)


def raw_bytes(text: str) -> bytes | None:
    """Lenient Base64: missing padding is added; None for what cannot be decoded or is empty."""
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4)) or None
    except ValueError:
        return None


def decodings(data: bytes) -> Iterator[str]:
    """All texts that the bytes can be, by packing and then by encoding."""
    for unpack, encoding in itertools.product(PACKINGS, ENCODINGS):
        try:
            raw = unpack(data)
            yield raw[: len(raw) // 2 * 2 if encoding == "utf-16-le" else None].decode(encoding)
        except (zlib.error, OSError, EOFError, UnicodeDecodeError):
            pass


def few_controls(text: str) -> bool:
    return len(CONTROLS.findall(text)) <= MOST_CONTROLS * len(text)


def readable(text: str) -> float:
    return sum(c.isprintable() or c in "\r\n\t" for c in text) / len(text) if text else 0.0


def payload_text(text: str) -> str | None:
    """The most readable decoding of a Base64 payload, the first of equals; None if all look like binary data."""
    data = raw_bytes(text)
    best = max(filter(few_controls, decodings(data)), key=readable, default="") if data else ""
    return best.replace("\0", "") if readable(best) >= LEAST_READABLE and not WRONG.search(best) else None
