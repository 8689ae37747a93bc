"""How paths shrink to tags: plain functions on strings, used by the rewrite program. native.py says the same as column expressions."""

from __future__ import annotations

import regex

_SEPARATORS = regex.compile(r"[\\/]+")
_TRAILING_NUMBER = regex.compile(r"(.+?)\d+")
TAG_EXTENSION, TAG_NUMBER, TAG_STAMP, TAG_PATH = ".<ext>", "<n>", "<timestamp>", "<path>"
#: One or more characters that count as digits anywhere in Unicode.
DIGITS = r"[\p{Numeric_Type=Decimal}\p{Numeric_Type=Digit}]+"
#: What a file name is, by its last extension (up to an @); without one, by how the name begins.
KIND = regex.compile(
    rf"(?s).*\.(?:(?P<program>exe)|(?P<version>{DIGITS})|(?P<extension>[^.@]{{0,8}})|(?P<long>[^.@]*))(?:@[^.]*)?"
    rf"|(?P<number>{DIGITS})|(?P<stamp>(?:[0-9]{{10}}|[0-9]{{13}})\b.*)|(?P<word>.*)"
)
#: What stands for a name of each kind; the last three only if names without an extension are kept.
SHORT = {
    "program": lambda m: m[0],
    "version": lambda m: "",
    "extension": lambda m: "." + m["extension"],
    "long": lambda m: TAG_EXTENSION,
    "number": lambda m: TAG_NUMBER,
    "stamp": lambda m: TAG_STAMP,
    "word": lambda m: _TRAILING_NUMBER.sub(r"\1", m[0]),
}
BARE = ("number", "stamp", "word")


def pieces(path: str | None) -> list[str]:
    return [p for p in _SEPARATORS.split(path or "") if p]


def short_name(name: str, keep: bool = False) -> str:
    """A file name's extension (whole name of an exe); without a dot nothing, or the name without numbers if it is to be kept."""
    m = KIND.fullmatch(name)
    return SHORT[m.lastgroup](m) if keep or m.lastgroup not in BARE else ""


def tagged(tag: str, parts: list[str], keep_first: bool = False, keep_name: bool = False) -> str:
    """tag \\ first folder (if kept) \\ <path> (for two and more folders) \\ short name, as far as each is there."""
    *folders, name = parts or [""]
    slots = (tag, *(f.lower() for f in folders[: int(keep_first)]), TAG_PATH * (len(folders) > 1), short_name(name, keep_name).lower())
    return "\\".join(filter(None, slots))


def base_name(path: str) -> str:
    return path[max(path.rfind("/"), path.rfind("\\")) + 1 :]


def plain_exe(command: str) -> bool:
    """Whether a command is nothing but a path to a program on drive C."""
    return bool(regex.fullmatch(r"[Cc]:\\[\\0-9A-Za-z_ ]*\.exe", command.strip('"')))


def shorten_exe(command: str) -> str:
    """First two parts and the program of a plain exe path; a long name with spaces becomes .exe."""
    bar = "\\\\" if "\\\\" in command else "\\"
    *folders, name = command.split(bar)
    name = ".exe" if " " in name and len(name) > 10 else name
    return bar.join([*folders[:2], name])
