"""Preparing and rewriting over Arrow batches: rule after rule, each on the rows of a slice that it can touch.

Texts of printable ASCII, nearly all commands, go together. On these, words, white
space and letter case mean the same to every engine of patterns, and ``$`` is the
end alone; what rules put in is printable ASCII, too, so they stay such. A rule
looks for the literals that it needs in all of a slice's bytes at once, and then
Arrow's engine, which takes time linear in the text, replaces. Where a pattern
looks around itself, or its replacement is made by a function, that engine only
finds the rows in which the pattern without what it looks at occurs, and the plain
rule makes them. Other texts are made by the plain rules one by one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cmdline, paths, rules

SLICE_ROWS, SLICE_BYTES = 1 << 14, 1 << 23  # of texts that go together: the engine learns a pattern anew for each slice
FEW = 16  # one in so many
PAYLOADS = "base64_call"
PRINTABLE = "^[ -~]*$"
#: What a text holds that preparing changes, and one that is nothing but a program's path.
TO_PREPARE, PLAIN_EXE = '[|&<]|>>|  |""|^ | $', r'^"*[Cc]:\\[\\0-9A-Za-z_ ]*\.exe"*$'
#: Literals of which a text in lower case holds one wherever the rule matches: a few, since a look for one costs a quarter of a pattern's.
LITERALS: dict[str, tuple[str, ...]] = {
    "echo_pass": ("echo ",), "tcp_host_port": ("tcp:",), "environment_call": ("getenvironmentvariable",), "port_equals": ("port",), "metric": ("metric",), "interface": ("interface",), "name_number": ("name", "/pjob"), "wmic_process": ("process ",),
    "skip": ("skip", "seconds", "timespan"), "pid": ("pid ",), "process_id": ("processid", "idprocess"), "parent_process_id": ("parentprocessid",), "event_id": ("eventid", "idevent"), "find_pid": ("find ",), "code_page": ("chcp ",), "wmic_interface": ("interfaceindex",),
    "api_key": ("-apikey",), "key_option": ("key=", "key:"), "token_option": ("-token", "auth"), "pipe_name": ("-pipename", "-instancename"), "password": ("password",), "username": ("username=", "user="), "url_password": ("pwd=",),
    "account_key": ("-acctkey",), "arn": ("arn:aws:",), "encoded_params": ("encoded",), "amp": ("amp=", "amp:"), "wmic_node": ("/node:",), "certificate": ("certhash", "code=", "code "), "url": ("http",), "url_address": ("http",),
    "sid": ("s-1-",), "task_time": ("/st ", "/du "), "current_date": ("curdate=",), "load_numbers": ("loadrepno=",), "tries": ("/try:",), "install_key": ("-ipk ",), "docker_port": (" -p ",), "port_option_equals": ("--port=",), "tmp_linux": ("/tmp/",),
    "slash_date": ("/20", "-20"), "time": ("am", "pm"), "time_date": ("am ", "pm "), "relative": ("./", ".\\"), "v6_inside": (":",), "v6_outside": (":",), "v4_outside": (".",), "bare_file": (".",), "domain": (".",), "cmd_separators": (",", ";"), "backtick": ("`",),
    "unix_path": ("/",), "unix_folders": ("/",), "flag_cluster": ("/",), "simple_relative": ("/", "\\"), "other_drives": ("/", "\\"), "guid": ("-",), "hex_pair": ("-",), "product_key": ("-",), "client_id": (":",), "correlation_vector": (".",),
    "users": ("users",), "program_files": ("program files",), "program_data": ("programdata",), "windows": ("windows",), "drive_c": ("c:/", "c:\\", "/c/", "\\c/", "c\\"),
}
_MD5 = "|".join(f"[0-9]{{{k}}}[a-f][0-9a-f]{{{31 - k}}}" for k in range(32))
#: Rules that look around themselves, said without: pattern, template, and what a text must not hold for both to be equal.
EQUALS: dict[str, tuple[str, str, str | None]] = {
    "md5": (rf"(?i)\b(?:{_MD5})\b", "<md5>", None),  # by the place of the first letter
    "sid": (r"(?i)(^|[^A-Za-z])S-1-\d+(?:-\d+)+", r"\1<SID>", r"(?i)\dS-1-\d"),  # the character before may be another match's last
}


def _parsed(pattern: str) -> Iterator[tuple[str, int]]:
    """The pattern in characters, escapes and sets, each with the depth of groups that it stands in."""
    depth = 0
    for m in regex.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:\?(?:<?[=!]|[a-zA-Z]*[:)]))?|.", pattern, regex.S):
        if m[0] == ")":
            depth -= 1
        yield m[0], depth
        if m[0][0] == "(" and m[0][-1] != ")":
            depth += 1


def loose(pattern: str) -> str:
    """A pattern that occurs wherever the given one does, without what it looks at around itself; what it looks at first or last is kept as a part of it."""
    parts, out, i = list(_parsed(pattern)), [], 0
    while i < len(parts):
        part, depth = parts[i]
        if part in ("(?=", "(?!", "(?<=", "(?<!"):
            end = next(k for k in range(i + 1, len(parts)) if parts[k] == (")", depth))
            inner = "".join(p for p, _ in parts[i + 1 : end])
            one = end == i + 2 and inner[0] == "["
            other = ("[" + inner[2:] if inner[1] == "^" else "[^" + inner[1:]) if one else ""
            if depth == 0 and end == len(parts) - 1 and part in ("(?=", "(?!"):
                out.append(f"(?:{inner})" if part == "(?=" else f"(?:{other}|$)" if one else "")
            elif depth == 0 and "".join(out) in ("", "(?i)", "(?s)") and part == "(?<!" and one:
                out.append(f"(?:^|{other})")
            i = end + 1
            continue
        out.append(".*" if regex.fullmatch(r"\\[1-9]", part) else part)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Step:
    rule: rules.Rule
    literals: tuple[bytes, ...]
    any_case: bool
    pattern: str | None  # to replace by
    template: str
    unless: str | None
    loose: str  # to find rows for the plain rule by


def _taken(pattern: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


@cache
def steps() -> tuple[Step | str, ...]:
    """All rules but the last, and the marks between them."""
    out: list[Step | str] = []
    for x in rules.PROGRAM:
        if isinstance(x, str):
            out.append(x)
        elif x.name != PAYLOADS:
            need = rules.NEED.get(x.name)
            words = LITERALS.get(x.name) or ((need,) if isinstance(need, str) else ())
            own = x.pattern.pattern
            pattern, template, unless = EQUALS.get(x.name) or (own if isinstance(x.replacement, str) and _taken(own) else None, x.replacement if isinstance(x.replacement, str) else "", None)
            out.append(Step(x, _bytes(words), x.name in LITERALS, pattern, template, unless, loose(own)))
    return tuple(out)


class Texts:
    """Texts, and their bytes one behind the other and in lower case, for as long as the texts stay."""

    def __init__(self, array: pa.StringArray):
        self.array = array
        self._data: tuple[bytes, list[int]] | None = None
        self._low: Texts | None = None

    def data(self) -> tuple[bytes, list[int]]:
        """All bytes, and where each text ends."""
        if self._data is None:
            _, at, chars = self.array.buffers()
            at = np.frombuffer(at, np.int32)[self.array.offset : self.array.offset + len(self.array) + 1]
            self._data = (b"" if chars is None else chars[int(at[0]) : int(at[-1])].to_pybytes(), (at[1:] - at[0]).tolist())
        return self._data

    def low(self) -> Texts:
        if self._low is None:
            self._low = Texts(pc.ascii_lower(self.array))
        return self._low

    def changed(self, rows: np.ndarray, new: pa.Array) -> Texts:
        """These texts with those of some rows (a mask) replaced."""
        if rows.all():
            return Texts(new)
        return Texts(pc.replace_with_mask(self.array, pa.array(rows), new))

    def _found(self, word: bytes) -> list[int] | None:
        """The rows that hold a word, None if they are more than a few."""
        chars, ends = self.data()
        found, at = [], chars.find(word)
        while at >= 0:
            row = bisect_right(ends, at)
            if at + len(word) <= ends[row]:
                found.append(row)
                if len(found) > len(ends) // FEW:
                    return None
                at = chars.find(word, ends[row])
            else:  # from one text into the next
                at = chars.find(word, at + 1)
        return found

    def holding(self, words: tuple[bytes, ...]) -> np.ndarray:
        """Which texts hold one of the words."""
        out = np.zeros(len(self.array), bool)
        for word in words:
            found = self._found(word)
            if found is None:
                out |= pc.match_substring(self.array, word.decode()).to_numpy(zero_copy_only=False)
            else:
                out[found] = True
        return out

    def perhaps_holding(self, words: tuple[bytes, ...]) -> np.ndarray:
        """Which texts may hold one of the words: all, where more than a few do."""
        out = np.zeros(len(self.array), bool)
        for word in words:
            found = self._found(word)
            if found is None:
                return np.ones(len(self.array), bool)
            out[found] = True
        return out


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _each(texts: pa.Array, change) -> pa.Array:
    return pa.array(list(map(change, texts.to_pylist())), pa.string())


def _where(texts: Texts, rows: np.ndarray, change) -> Texts:
    return texts.changed(rows, _each(texts.array.filter(pa.array(rows)), change)) if rows.any() else texts


def _plainly(texts: Texts, rows: np.ndarray, step: Step) -> Texts:
    """The plain rule on some rows, where it can match at all."""
    rows = rows.copy()
    rows[rows] = _matches(texts.array.filter(pa.array(rows)), step.loose)
    return _where(texts, rows, lambda t: step.rule.pattern.sub(step.rule.replacement, t))


def _applied(texts: Texts, rows: np.ndarray, step: Step) -> Texts:
    if step.pattern is None:
        return _plainly(texts, rows, step)
    if step.unless is not None:
        odd = rows & _matches(texts.array, step.unless)
        if odd.any():
            texts, rows = _plainly(texts, odd, step), rows & ~odd
    old = texts.array if rows.all() else texts.array.filter(pa.array(rows))
    new = pc.replace_substring_regex(old, step.pattern, step.template)
    return texts if new.equals(old) else texts.changed(rows, new)


def _printable_ruled(array: pa.StringArray, prepare: bool) -> pa.Array:
    texts = Texts(array)
    if prepare:
        texts = _where(texts, _matches(texts.array, TO_PREPARE), cmdline.prepared)
    texts = _where(texts, _matches(texts.array, PLAIN_EXE), paths.shorten_exe)
    every = np.ones(len(array), bool)
    lower, slash, open_ = Texts(array), ~every, every
    was_lower: dict[tuple[str, ...], np.ndarray] = {}
    for step in steps():
        if step == "lower":
            lower = texts.low()
        elif step == "slash":
            slash = texts.holding((b"/",))
        else:
            gate = step.rule.gate
            if step.rule.number not in rules._SHARED_GATE:
                open_ = slash if gate is not None and gate.slash else every
                if gate is not None and gate.text:
                    open_ = open_ & texts.holding(_bytes(gate.text))
                if gate is not None and gate.lower:
                    if gate.lower not in was_lower:
                        was_lower[gate.lower] = lower.holding(_bytes(gate.lower))
                    open_ = open_ & was_lower[gate.lower]
            rows = open_
            if step.literals and rows.any():
                rows = rows & (texts.low() if step.any_case else texts).perhaps_holding(step.literals)
            if rows.any():
                texts = _applied(texts, rows, step)
    return texts.array


def _bytes(words: tuple[str, ...]) -> tuple[bytes, ...]:
    return tuple(w.encode() for w in words)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, "right"))
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS)
        yield texts.slice(lo, hi - lo).cast(pa.string())
        lo = hi


def ruled_batch(texts: pa.Array, prepare: bool) -> pa.Array:
    """Texts after all rules but the last, prepared before if that is asked for; null stays null."""
    out = []
    plainly = (lambda t: rules.rewrite_but_payloads(cmdline.prepared(t))) if prepare else rules.rewrite_but_payloads
    for part in _slices(texts):
        printable = pc.match_substring_regex(part, PRINTABLE)
        fast = pc.fill_null(printable, False).to_numpy(zero_copy_only=False)
        slow = pc.fill_null(pc.invert(printable), False).to_numpy(zero_copy_only=False)
        rows = Texts(part)
        if fast.any():
            rows = rows.changed(fast, _printable_ruled(part if fast.all() else part.filter(pa.array(fast)), prepare))
        out.append(_where(rows, slow, plainly).array)
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def ruled(texts: pa.Array) -> pa.Array:
    return ruled_batch(texts, prepare=False)


@F.arrow_udf(T.StringType())
def rewritten(texts: pa.Array) -> pa.Array:
    """Command lines as a shape's rules leave them: prepared and ruled."""
    return ruled_batch(texts, prepare=True)
