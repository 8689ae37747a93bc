"""The rewrite program of command lines: a table of rules that run in order, each on the result of those before.

A rule has a number, a gate (a cheap test that must hold), a pattern and a
replacement: a template, or a function of the match. Two marks in the table,
``lower`` and ``slash``, take a snapshot of the text as it is there; later gates
look at the snapshots, not at the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import regex

from . import decode, paths
from .paths import TAG_PATH, base_name, pieces, short_name, tagged

# Patterns of parts of addresses, paths and keys.
_V4_BYTE = r"(?:25[0-5]|(?:2[0-4]|1{0,1}[0-9]){0,1}[0-9])"
_V4 = rf"(?:(?:{_V4_BYTE}\.){{3,3}}{_V4_BYTE})"
_V6_PART = r"(?:(?:[0-9a-fA-F]){1,4})"
_V6 = "|".join(
    (
        rf"(?:(?:{_V6_PART}:){{1,4}}:[^\s:]{_V4})",
        rf"(?:::(?:ffff(?::0{{1,4}}){{0,1}}:){{0,1}}[^\s:]{_V4})",
        rf"(?:fe80:(?::{_V6_PART}){{0,4}}%[0-9a-zA-Z]{{1,}})",
        rf"(?::(?:(?::{_V6_PART}){{1,7}}|:))",
        rf"(?:{_V6_PART}:(?:(?::{_V6_PART}){{1,6}}))",
        rf"(?:(?:{_V6_PART}:){{1,2}}(?::{_V6_PART}){{1,5}})",
        rf"(?:(?:{_V6_PART}:){{1,3}}(?::{_V6_PART}){{1,4}})",
        rf"(?:(?:{_V6_PART}:){{1,4}}(?::{_V6_PART}){{1,3}})",
        rf"(?:(?:{_V6_PART}:){{1,5}}(?::{_V6_PART}){{1,2}})",
        rf"(?:(?:{_V6_PART}:){{1,6}}:{_V6_PART})",
        rf"(?:(?:{_V6_PART}:){{1,7}}:)",
        rf"(?:(?:{_V6_PART}:){{7,7}}{_V6_PART})",
    )
)
_V4_INSIDE = r"(?:127\.|10\.|172\.(?:1[6-9]|2[0-9]|3[0-1])\.|192\.168\.|169\.254\.)"
_V6_INSIDE = r"(?:fe80:|f[cd][0-9a-fA-F]{2}:|::1(?![0-9a-fA-F]))"
_FLAG = r"\s(?:/|--?)[a-zA-Z][-a-zA-Z0-9]*(?![./\\])"
_HIVE = r"(?:HKEY_LOCAL_MACHINE|HKLM|HKEY_CURRENT_USER|HKCU|HKEY_CLASSES_ROOT|HKCR|HKEY_USERS|HKU|HKEY_CURRENT_CONFIG|HKCC)"
_OWN_C = r"(?!(?:Program Files|ProgramData|Users|Windows|Temp)\b)"
_C_ROOT = r"(?:C:|/c|\\mnt\\c)[/\\]+"
_SCRIPT = r"(py|txt|js|sh|tar|log|dat|bat|ps1|zip|rar|gz|csv|xml|json|yaml|pdf|sln|doc|docx|xls|xlsx|ppt|pptx|cmd)"


def _c_folder(folder: str, below: str = "") -> str:
    """A path under a folder of drive C: after a quote of either kind, after a space, or bare. Each branch has a group for what lies below."""
    root = rf"(?:C:|/c)[/\\]+{folder}[/\\]+{below}"
    quoted = r"(?<={q}){root}({inside})(?={q}|&|{flag}|$)"
    return "(?:" + "|".join(
        (
            quoted.format(q='"', root=root, inside=r'[^"<>|&:]?', flag=_FLAG),
            quoted.format(q="'", root=root, inside=r"[^'<>|&:]*?", flag=_FLAG),
            rf'(?<= ){root}([^"<>|&:]*?)(?="|&|{_FLAG}|$)',
            rf"(?<![\"']){root}([^\"<>|&:\s]*)(?=\s|[\"']|$)",
        )
    ) + ")"


def _groups(m: regex.Match) -> str:
    """The first group that holds anything."""
    return next((g for g in m.groups() if g), "")


def _under(tag: str, **keep: bool) -> Callable[[regex.Match], str]:
    return lambda m: tagged(tag, pieces(_groups(m)), **keep)


def _of_name(path: str) -> str:
    return tagged(TAG_PATH, pieces(base_name(path)))


def _relative(m: regex.Match) -> str:
    return _of_name(m[0].removeprefix("./"))


def _below_variable(m: regex.Match) -> str:
    return _of_name(m[0].split("%", 2)[2])


def _unix_folder(m: regex.Match) -> str:
    below = (m[2] or "").lstrip("/")
    if "/" not in below:
        return "\\" + m[1].lower()
    return "\\".join(x for x in (TAG_PATH, short_name(below.rpartition("/")[2])) if x)


def _unc(m: regex.Match) -> str:
    return tagged("<int_ip>" if "<int_ip>" in m[0] else "<ext_ip>", pieces(_groups(m)))


def _linker_out(m: regex.Match) -> str:
    parts = pieces(m[1])
    return "/out:" + (TAG_PATH + "\\" if len(parts) > 1 else "") + (short_name(parts[-1]) if parts else "")


def _object_file(m: regex.Match) -> str:
    parts = pieces(m[1])
    return short_name(m[1].replace("/", "\\")) if len(parts) < 2 else TAG_PATH + "\\" + short_name(parts[-1])


def _decoded(m: regex.Match) -> str:
    text = decode.payload_text(m[1])
    return "<payload>" if text is None else text.replace("'", "''")


@dataclass
class State:
    text: str
    lower: str = ""
    slash: bool = False


@dataclass(frozen=True)
class Gate:
    """What must hold for a rule to run: one of some words in the text, one of some in the snapshot of the lower-case text, a slash at its mark."""

    text: tuple[str, ...] = ()
    lower: tuple[str, ...] = ()
    slash: bool = False

    def __call__(self, s: State) -> bool:
        return (not self.text or any(w in s.text for w in self.text)) and (not self.lower or any(w in s.lower for w in self.lower)) and (not self.slash or s.slash)


def _has(*words: str) -> Gate:
    return Gate(text=words)


def _had(*words: str) -> Gate:
    return Gate(lower=words)


_slash = Gate(slash=True)
_CMD, _SHELL, _TEMP, _BUILD, _GIT, _WMIC = _had("cmd.exe"), _had("powershell.exe"), _had("temp"), _had("msbuild", "msvc", "vcxproj"), _had("git"), _had("wmic")
_SCRIPTS, _ADDRESS, _PORT = _had("wscript", "vbs"), _has("_ip"), _has(" --port")
_caret = Gate(text=("^",), lower=("cmd.exe",))


@dataclass(frozen=True)
class Rule:
    number: int
    pattern: regex.Pattern
    replacement: str | Callable[[regex.Match], str]
    gate: Gate | None = None
    name: str = ""

    def __call__(self, s: State) -> None:
        if self.gate is None or self.gate(s):
            s.text = self.pattern.sub(self.replacement, s.text)


def _literal(text: str) -> str:
    return regex.escape(text)


# Pattern, replacement, gate and name of each rule, in order. (?i) marks those that ignore case.
_TABLE: list[tuple | str] = [
    (2, r"chrome\.nativeMessaging\.(out|in)\.[a-z0-9]{10,32}", r"chrome.nativeMessaging.\1.<id>", None, "chrome_message"),
    (3, r"\\pipe\\chrome", "chrome", None, "chrome_pipe"),
    (4, r"chrome-extension://[a-z0-9]{32}/", "<chrome_extension_id>", None, "chrome_extension"),
    (5, r"""(?i)echo\s(['"]?)[a-z0-9]{12,16}\1""", "echo <pass>", None, "echo_pass"),
    (6, r"\b[0-9A-Fa-f]{64}\b", "<sha256>", None, "sha256"),
    (7, r"(?i)\bC:[/\\]+PROGRA~[12][/\\]+", r"C:\\Program Files\\", None, "dos_program_files"),
    (7, r"(?i)\bC:[/\\]+PROGRA~3[/\\]+", r"C:\\ProgramData\\", None, "dos_program_data"),
    (7, r"(?i)\bC:[/\\]+WINDOW~1[/\\]+", r"C:\\Windows\\", None, "dos_windows"),
    (8, r"(?i)([A-Za-z0-9_]+)~+\d+", r"\1", None, "dos_name"),
    (9, r"""(^|\s|[\\"]*")(/tmp/\S+)\.(\w+)(?=[\\"]*"|\s|$)""", r"\1<tmp>.\3", _has("/tmp/"), "tmp_linux_ext"),
    (10, r"""(^|\s|[\\"]*")(/tmp/\S+)(?=[\\"]*"|\s|$)""", r"\1<tmp>", None, "tmp_linux"),  # same gate, see below
    "lower",
    (11, r"(\w)\^\&([\s\S])", r"\1\2", _caret, "caret_and"),
    (12, r"\^([\s\S])", r"\1", _CMD, "caret"),
    (13, r'("[^"]*")|([,;])', lambda m: m[1] or " ", _CMD, "cmd_separators"),
    (14, r"('(?:''|[^'])*')|`([\s\S])", lambda m: m[1] or m[2], _SHELL, "backtick"),
    (15, r'(?i)(?:C:|/c)[/\\]+Temp[/\\]+[^"<>|&:?*]*?\.(\w+)(?="|$|\s)', r"<tmp>.\1", _TEMP, "temp_ext"),
    (16, r'(?i)(?:C:|/c)[/\\]+Temp[/\\]+[^"<>|&.:?*]+(?="|$|\s)', "<tmp>", _TEMP, "temp"),
    (17, r'(?i)(?:C:|/c)[/\\]+Windows[/\\]+Temp[/\\]+[^"<>|&:?*]*?\.(\w+)(?="|$|\s)', r"<tmp>.\1", _TEMP, "windows_temp_ext"),
    (18, r'(?i)(?:C:|/c)[/\\]+Windows[/\\]+Temp[/\\]+[^"<>|&.:?*]+(?="|$|\s)', "<tmp>", _TEMP, "windows_temp"),
    (19, r'(?i)(?:C:|/c)[/\\]+Users[/\\]+[^/\\]+[/\\]+AppData[/\\]+Local[/\\]+Temp[/\\]+[^"<>|&]*?\.(\w+)(?="|$|\s)', r"<tmp>.\1", _TEMP, "users_temp_ext"),
    (20, r'(?i)(?:C:|/c)[/\\]+Users[/\\]+[^/\\]+[/\\]+AppData[/\\]+Local[/\\]+Temp[/\\]+[^"<>|&.]+(?="|$|\s)', "<tmp>", _TEMP, "users_temp"),
    (21, r"(?:(?<=\s)|(?<=^))(?:/[a-zA-Z]){2,}\b", lambda m: m[0].replace("/", " /"), None, "flag_cluster"),
    (22, rf"""(?i)(?<!<reg>)\b({_HIVE}(?:\\[^"<>|/\r\n]*?)?)(?=\s[^a-z0-9]|["']|$|\))""", r"(<reg>\1)", _has("hk"), "registry"),
    "slash",
    (23, r"""(?i)(?:[\\"]*")?(?<![a-z0-9./])/(etc|usr|var|opt|home|bin|sbin|lib)(/[^\s"'\\:;|&]+)?(?:[\\"]*")?(?=\s|"|'|$|[;|&])""", _unix_folder, _slash, "unix_folders"),
    (24, "(?i)" + _c_folder(r"Program\ Files(?:\s\(x86\))?"), _under("<program_files>"), None, "program_files"),
    (25, "(?i)" + _c_folder("ProgramData"), _under("<ProgramData>", keep_first=True), None, "program_data"),
    (26, "(?i)" + _c_folder("Users", r"[^/\\]+(?:[/\\]+|$)"), _under("<Users>"), None, "users"),
    (27, "(?i)" + _c_folder("Windows"), _under("<Windows>", keep_name=True), None, "windows"),
    (28, rf"""(?i)(?:(?<="){_C_ROOT}{_OWN_C}([^"<>|&]+?)(?=")|(?<='){_C_ROOT}{_OWN_C}([^'<>|&]+?)(?=')|(?<!["']){_C_ROOT}{_OWN_C}([^\s"'<>|&]+)(?=\s|["']|$))""", _under("<C>", keep_first=True), None, "drive_c"),
    (29, r"""(?i)(?:\b[A-BD-Z]:|/[a-bd-z])[/\\]+([^"<>|&:?*]+?)(?="|$|\s[-/]|\s/|\s\w+\s[-/]|\s*&&|\s*\|\||\s*\||\s*;|\s\\\\)""", _under(TAG_PATH), None, "other_drives"),
    (30, r"(?:<path>\\)?\.vcxproj\b|\b[^\s\\\/]+\.vcxproj\b", "<vcxproj>", _BUILD, "vcxproj"),
    (31, r"(?i)VisualStudioVersion=\d+\.\d+", "<vs_version>", _BUILD, "vs_version"),
    (32, r"(?i)Configuration=\d+", "<vs_configuration>", _BUILD, "vs_configuration"),
    (33, r"(?i)Platform=\d+", "<vs_platform>", _BUILD, "vs_platform"),
    (34, r'(?i)/out:([^\s"]+)', _linker_out, _BUILD, "linker_out"),
    (35, r'(?i)(?<=\s)([^\s"<>]+\.obj)\b', _object_file, _BUILD, "object_file"),
    (36, r"[A-Za-z0-9+/]{16,22}(?:\.\d+)+", "<id>", None, "correlation_vector"),
    (37, r"""(?i)(?<![a-zA-Z0-9.])(?:/cygdrive/[a-z](?:/[^\s"'\\:;|&/]+)+|/mnt/[a-z](?:/[^\s"'\\:;|&/]+)+|/[a-z](?:/[^\s"'\\:;|&/]+){2,})/([^\s"'\\:;|&/]+)""", lambda m: "\\".join(x for x in (TAG_PATH, short_name(m[1])) if x), _slash, "unix_path"),
    (38, rf"""(?i)["']?(?<![a-zA-Z0-9])(?:localhost|(?={_V4_INSIDE}){_V4})\b["']?""", "<int_ip>", None, "v4_inside"),
    (39, rf"""(?i)["']?(?<![a-zA-Z0-9])(?!{_V4_INSIDE}){_V4}\b["']?""", "<ext_ip>", None, "v4_outside"),
    (40, r"""["']?\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b["']?""", "<mac>", None, "mac"),
    (41, rf"""(?i)["']?(?<![a-zA-Z0-9])(?={_V6_INSIDE})(?:{_V6})(?![a-zA-Z0-9])["']?""", "<int_ip>", None, "v6_inside"),
    (42, rf"""(?i)["']?(?<![a-zA-Z0-9])(?!{_V6_INSIDE})(?:{_V6})(?![a-zA-Z0-9])["']?""", "<ext_ip>", None, "v6_outside"),
    (43, r"(?i)\b[a-z0-9._%+-]+@<(ext_ip|int_ip)>", r"<user>@<\1>", None, "login"),
    (44, r"\.ssh([\\/]+)[^\\/\s]+", r".ssh\1<ssh>", None, "ssh"),
    (45, r"""(?i)(?:(?<=")(?:\\\\\\\\|\\\\)(?:[a-zA-Z0-9][-a-zA-Z0-9.]*)[/\\]+([^"<>|&]+?)(?=")|(?<![:"a-z0-9\\])(?:\\\\\\\\|\\\\)(?:[a-zA-Z0-9][-a-zA-Z0-9.]*)[/\\]+([^\s"<>|&]+))""", _under("<host>"), None, "unc_host"),
    (46, r"""(?i)(?:(?<=")\\\\<(?:int|ext)_ip>[/\\]+([^"<>|&]+?)(?=")|(?<!["])\\\\<(?:int|ext)_ip>[/\\]+([^\s"<>|&]+))""", _unc, _ADDRESS, "unc_address"),
    (47, r"(\d+):<(int|ext)_ip>:(\d+)", r"<port>:<\2_ip>:<port>", _ADDRESS, "port_address_port"),
    (48, r"<(int|ext)_ip>:(\d+)", r"<\1_ip>:<port>", _ADDRESS, "address_port"),
    (49, r"<(int|ext)_ip>,(\d+)", r"<\1_ip>,<port>", _ADDRESS, "address_comma_port"),
    (50, r"(?i)(tcp:)([A-Za-z][A-Za-z0-9_-]*),(\d+)", r"\1<host>,<port>", None, "tcp_host_port"),
    (51, r"\s+-p\s+\d+:\d+", " -p <port>:<port>", None, "docker_port"),
    (52, r"""(?i)getenvironmentvariable\s*\(\s*['"][^'"]+['"]\s*\)""", "getenvironmentvariable('<env>')", None, "environment_call"),
    (53, _literal("0" * 40), "<commit_hash>", _GIT, "no_commit"),
    (54, r"(?i)\b(?=(?:[0-9]*[a-f])+)[0-9a-f]{7}\b|\b(?=(?:[0-9]*[a-f])+)[0-9a-f]{40}\b", "<commit_hash>", _GIT, "commit"),
    (55, r"""(\s--port\s)["']?(\d+)["']?""", r"\1<port>", _PORT, "port_option"),
    (56, r"""(\s--port=)["']?(\d+)["']?""", r"\1<port>", None, "port_option_equals"),  # same gate, see below
    (57, r"\skill-port (\d+)", " kill-port <port>", _has(" kill-port "), "kill_port"),
    (58, r"""(?i)(findstr\s["']?:)\d+""", r"\1<n>", _had("findstr"), "findstr_port"),
    (59, r"(?i)(display_cursor\s*\(\s*')[^']+(')", r"\1<id>\2", _had("display_cursor"), "cursor"),
    (60, r"""(?i)(\blistenport\s*=\s*|\bport\s*=\s*|-UniversalPort\s)["']?(\d+)["']?""", r"\1<port>", None, "port_equals"),
    (61, r"""(?i)(\bmetric\s*=\s*)["']?(\d+)["']?""", r"\1<n>", None, "metric"),
    (62, r"""(?i)(\binterface\s*=\s*)["']?(\d+)["']?""", r"\1<n>", None, "interface"),
    (63, r"""(?i)((\bname|/pjob)\s*=\s*)["']?(\d+)["']?""", r"\1<n>", None, "name_number"),
    (64, r"""([\s"'])sleep (\d*[\.\d]\d*)""", r"\1sleep <s>", None, "sleep"),
    (65, r"(?i)(-(skip|seconds|timespan)\s)\d+", r"\1<n>", None, "skip"),
    (66, r"(?i)\b/?pid(?:\seq)?\s(\d+)", "pid <PID>", None, "pid"),
    (67, r"(?i)(-(?:eq|ne|lt|gt|le|ge|id)\s)\d+", r"\1<PID>", None, "compare"),
    (68, _literal('"pid <PID>"'), "pid <PID>", None, "quoted_pid"),
    (69, r"""(?i)\b(ProcessId|IDProcess)\s*!?=?\s*["']?(\d+)["']?""", "ProcessId <PID>", None, "process_id"),
    (70, r"""(?i)\bParentProcessId\s*!?=?\s*["']?(\d+)["']?""", "ParentProcessId <PID>", None, "parent_process_id"),
    (71, r"""(?i)\b(EventID|IDEvent)\s*!?=?\s*["']?(\d+)["']?""", "EventID <id>", None, "event_id"),
    (72, r'(?i)\bfind\s("{0,2})(\d+)\1(?=\s|$)', "find <PID>", None, "find_pid"),
    (73, r"(?i)\bchcp\s(\d+)", "chcp <code>", None, "code_page"),
    (74, r"(?i)(-ApiKey\s)([A-Za-z0-9+/=_-]+)", r"\1<key>", None, "api_key"),
    (75, r'(?i)([-/]+key[=:]|SecretKey=)([^\s"]+)', r"\1<key>", None, "key_option"),
    (76, r"""(?i)((-token|\b[A-Z_]*AUTH[A-Z_]*TOKEN))\s*=?\s*["']?([\.a-z0-9+/=_-]+)["']?""", r"\1<token>", None, "token_option"),
    (77, r"(?i)(-(PipeName|InstanceName)\s)[0-9a-fA-F]+", r"\1<id>", None, "pipe_name"),
    (78, r"([-=]|(?<!:):)[A-Za-z0-9]{16}\b", r"\1<id>", None, "id_16"),
    (79, r"\b[0-9a-fA-F]{16,}-[0-9a-fA-F]{16,}\b", "<id>", None, "hex_pair"),
    (80, r"\b[a-z0-9]{5}-[a-z0-9]{5}-[a-z0-9]{5}-[a-z0-9]{5}(-[a-z0-9]{5})?", "<key>", None, "product_key"),
    (81, r"\b[0-9A-Fa-f]{24}\b", "<hex_id>", None, "hex_24"),
    (82, r"\b[A-Z0-9-]+(?::[0-9A-Fa-f]{4}){4,}\b", "<client_id>", None, "client_id"),
    (83, r"(?i)(-variablePassword\s|Password=|-password\s)['\"]?([A-Za-z0-9+/=]+)['\"]?", r"\1<pass>", None, "password"),
    (84, r"(?i)(username=|user=)['\"]?([A-Za-z0-9+/=]+)['\"]?", r"\1<user>", None, "username"),
    (85, r"""(?i)(\b\w*_?(?:session_)?pwd=)[^\s&"']+""", r"\1<pass>", None, "url_password"),
    (86, r"(?i)(-acctkey\s)[0-9a-fA-F]+", r"\1<key>", None, "account_key"),
    (87, r"""(?i)arn:aws:[a-z0-9-]+::[0-9]+:[^\s"']+""", "<arn>", None, "arn"),
    (88, r"(?i)([-/]+encoded[-_]?params?[=:])([A-Za-z0-9+/=_-]+)", r"\1<payload>", None, "encoded_params"),
    (89, r'(?i)([-/]+amp[=:])"*([^"]+\.amp)"*', r"\1<amp>", None, "amp"),
    (90, r'(?i)/node:"+([^"\s]+)"+|/node:([^\s]+)', "/node:<node>", None, "wmic_node"),
    (91, r"(?i)\bprocess\s(\d+)\b", "process <PID>", _WMIC, "wmic_process"),
    (92, r"(?i)\bInterfaceIndex\s*=\s*(\d+)", "InterfaceIndex=<id>", _WMIC, "wmic_interface"),
    (93, r"(?i)\bCurDate=(\d{8})\b", "CurDate=<date>", _SCRIPTS, "current_date"),
    (94, r'(?i)\bLoadRepNo="+([^"]+)"+|\bLoadRepNo=(\S+)', "LoadRepNo=<ids>", _SCRIPTS, "load_numbers"),
    (95, r"(?i)/try:(\d+)", "/try:1", _SCRIPTS, "tries"),
    (96, r"(?i)(-ipk\s)[A-Z0-9]{5}-[A-Z0-9]{5}-[A-Z0-9]{5}-[A-Z0-9]{5}-[A-Z0-9]{5}", r"\1<key>", _SCRIPTS, "install_key"),
    (97, r"\s/duration (\d+)", " /duration <s>", _has(" /duration "), "duration"),
    (98, rf"(?i)(?<![/\\])(\s|^)[^\s/\\<>]+\.{_SCRIPT}\b", r"\1.\2", None, "bare_file"),
    (99, r"""["']?\{?[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\}?["']?""", "<guid>", None, "guid"),
    (100, r"(?i)(\b(certhash|code)\s*=\s*)[0-9a-fA-F]{40}\b", r"\1<hash>", None, "certificate"),
    (101, r"(?i)\b(?=[0-9a-f]*[a-f])[0-9a-f]{32}\b", "<md5>", None, "md5"),
    (102, r"\b(?:[A-Za-z0-9]{95,106}|[A-Za-z0-9]{31,33}|[A-Za-z0-9]{128,}|[A-Za-z0-9]{48}|[A-Za-z0-9]{36})\b", "<token>", None, "long_token"),
    (103, r"\$([a-zA-Z0-9_:]+)(\s*=)", r"$<env>\2", None, "assignment"),
    (104, r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "<email>", None, "email"),
    (105, r"""(?i)https?://[^\s"'<>]+""", "<url>", None, "url"),
    (106, r"""(?i)https?://<(int|ext)_ip>(?::\d+)?(?:/[^\s"'<>]*)?""", "<url>", None, "url_address"),
    (107, r"""(?i)(?<![/\\])\b[a-z0-9][-a-z0-9]*(?:\.[a-z0-9][-a-z0-9]*)*\.(com|net|org|io|edu|gov|co|info|biz|click)(?![a-z\.])(?:/[^\s"'<>]*)?""", "<url>", None, "domain"),
    (108, r"<url>:(\d+)", "<url>:<port>", None, "url_port"),
    (109, r"""%[A-Za-z0-9_]+%[/\\]+[^\s"'<>]+""", _below_variable, None, "variable_path"),
    (110, r"""(?<![^\s"'<>])\.\.?[/\\]+(?:\.\.?[/\\]+)*[^\s"'<>:?*|]+""", _relative, None, "relative"),
    (111, r"""(?<![A-Za-z0-9]\s)(?<![^\s"'<>%])(?![^\\s"'<>]*%[/\\])(?![^\\s"'<>]*:)(?!<)(?!%)(?![A-Za-z]:)(?![hHkK])(?!\.\.?[/\\])\\?\\?[^\s"'<>:?*|/\\]+[/\\]+[^\s"'<>:?*|]+""", lambda m: _of_name(m[0]), None, "simple_relative"),
    (112, r"""\s([A-Za-z_]+[A-Za-z0-9_]*?)\-?(\d+)(?=\s|'|"|$)""", r" \1", None, "trailing_number"),
    (113, r"(?i)(?<![A-Za-z])S-1-\d+(?:-\d+)+", "<SID>", None, "sid"),
    (114, r"\b([0-9]{10}|[0-9]{13})\b", "<timestamp>", None, "timestamp"),
    (115, r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s*[AP]M\s\d{1,2}[/-]\d{1,2}[/-]20\d{2}\b", "<date>", None, "time_date"),
    (116, r"20\d{2}[-]?\d{2}[-]?\d{2}(?:[\sT-]?\d{2}[:-]?\d{2}[:-]?\d{2})?(?:\.\d+)?(?:[+-]\d+)?Z?", "<date>", None, "date"),
    (117, r"\b\d{1,2}[/-]\d{1,2}[/-]20\d{2}(?:[-T]\d{2}:\d{2}(?::\d{2})?)?\b", "<date>", None, "slash_date"),
    (118, r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s*[AP]M\b", "<date>", None, "time"),
    (119, r"(?i)(/(?:ST|DU)\s)\d{1,2}[:.]\d{2}(?:[:.]\d{2})?", r"\1<date>", None, "task_time"),
    (120, r"""(?i)(?:FromBase64String|base64\.b64decode)\s*\(\s*(?:[bB]?['"\\]*)?([A-Za-z0-9+/=]+)(?:['"\\]*)?\s*\)""", _decoded, None, "base64_call"),
]

PROGRAM: list[Rule | str] = [x if isinstance(x, str) else Rule(x[0], regex.compile(x[1]), x[2], x[3], x[4]) for x in _TABLE]
RULES: dict[str, Rule] = {r.name: r for r in PROGRAM if isinstance(r, Rule)}
#: Rules whose gate is that of the one before, as it was when that one began.
_SHARED_GATE = {10, 56, 12}
MARKS = {"lower": lambda s: setattr(s, "lower", s.text.lower()), "slash": lambda s: setattr(s, "slash", "/" in s.text)}


#: What a text must hold for a rule to match: a literal or a short pattern. A look for it costs a hundredth of the rule.
NEEDS: list[tuple[str | regex.Pattern, tuple[str, ...]]] = [
    ("chrome.native", ("chrome_message",)), ("\\pipe", ("chrome_pipe",)), ("chrome-", ("chrome_extension",)), ("~", ("dos_program_files", "dos_program_data", "dos_windows", "dos_name")),
    ("^", ("caret_and", "caret")), ("`", ("backtick",)), ("/", ("wmic_node", "task_time")), (":", ("arn",)),
    ("@<", ("login",)), (".ssh", ("ssh",)), ("\\\\", ("unc_host",)), (",", ("tcp_host_port",)), ("-p", ("docker_port",)), ("(", ("environment_call", "base64_call")),
    ("=", ("metric", "interface", "name_number", "username", "url_password", "assignment", "certificate")), ("sleep ", ("sleep",)), ("-", ("sid", "skip", "api_key", "account_key", "pipe_name")),
    ("@", ("email",)), ("://", ("url", "url_address")), ("<url>:", ("url_port",)), ("%", ("variable_path",)), ("20", ("date",)), ('"pid <PID>"', ("quoted_pid",)),
    (regex.compile(r":(?::|[0-9a-fA-F]{1,4}:|(?<=(?i:fe80):))"), ("v6_inside", "v6_outside")),
    (regex.compile(r"[.oO](?:(?<=\.)[0-9]{1,3}\.[0-9]|(?<=(?i:lo))(?i:calhost))"), ("v4_inside",)), (regex.compile(r"\.[0-9]{1,3}\.[0-9]"), ("v4_outside",)),
    (regex.compile(r"[0-9A-Za-z]{24}"), ("sha256", "md5", "hex_24", "long_token", "chrome_extension")),
    (regex.compile(r"[:-][0-9A-Fa-f]{2}[:-]"), ("mac",)),
    (regex.compile(r"(?i)token"), ("token_option",)), (regex.compile(r"(?i)key"), ("key_option",)), (regex.compile(r"(?i)port"), ("port_equals",)), (regex.compile(r"(?i)pass"), ("password",)),
    (regex.compile(r"(?i)(?:c:|[/\\]c)[/\\]"), ("program_files", "program_data", "users", "windows", "drive_c")),
    (regex.compile(r"[/\\](?<=(?i:\b[a-bd-z]:|/[a-bd-z])[/\\])"), ("other_drives",)),
    (regex.compile(r"""[^\s"'<>:?*|/\\][/\\]+[^\s"'<>:?*|]"""), ("simple_relative",)),
    (regex.compile(r"/[a-zA-Z]/[a-zA-Z]"), ("flag_cluster",)), (regex.compile(r"\.\d(?<=[A-Za-z0-9+/]{16}\.\d)"), ("correlation_vector",)), (regex.compile(rf"(?i)\.{_SCRIPT}\b"), ("bare_file",)), (regex.compile(r"(?i)/[a-z]/"), ("unix_path",)),
    (regex.compile(r"(?i)\.(?:com|net|org|io|edu|gov|co|info|biz|click)(?![a-z\.])"), ("domain",)), (regex.compile(r"\.[/\\]"), ("relative",)), (regex.compile(r"(?::[0-9A-Fa-f]{4}){4}"), ("client_id",)), (regex.compile(r":\d{2}"), ("time_date", "time")),
    (regex.compile(r"(?i)-(?:eq|ne|lt|gt|le|ge|id)\s\d"), ("compare",)), (regex.compile(r"-[0-9a-fA-F]{16}"), ("hex_pair",)), (regex.compile(r"(?:-[a-z0-9]{5}){3}"), ("product_key",)), (regex.compile(r"-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-"), ("guid",)), (regex.compile(r"[/-]20\d{2}"), ("slash_date",)),
    (regex.compile(r"(?i)/(?:etc|usr|var|opt|home|bin|sbin|lib)"), ("unix_folders",)),
    (regex.compile(r"\d(?:[\s'\"]|$)"), ("trailing_number",)),
    (regex.compile(r"(?i)pid|process|idprocess"), ("pid", "process_id", "parent_process_id")),
    (regex.compile(r"(?i)event"), ("event_id",)), (regex.compile(r"(?i)find"), ("find_pid",)), (regex.compile(r"(?i)chcp"), ("code_page",)), (regex.compile(r"(?i)echo"), ("echo_pass",)),
]
NEED = {name: test for test, names in NEEDS for name in names}
_FOUND = {name: test.search if isinstance(test, regex.Pattern) else test for name, test in NEED.items()}
STEPS = [x if isinstance(x, str) else (x, _FOUND.get(x.name, "")) for x in PROGRAM]


def _after(command: str, steps: list) -> str:
    s = State(paths.shorten_exe(command) if paths.plain_exe(command) else command)
    open_ = True
    for step in steps:
        if isinstance(step, str):
            MARKS[step](s)
            continue
        rule, need = step
        if rule.number not in _SHARED_GATE:
            open_ = rule.gate is None or rule.gate(s)
        if open_ and (need in s.text if isinstance(need, str) else need(s.text)):
            s.text = rule.pattern.sub(rule.replacement, s.text)
    return s.text


def rewrite(command: str) -> str:
    """The command after all rules."""
    return _after(command, STEPS).strip()


def rewrite_but_payloads(command: str) -> str:
    """The command after all rules but the last."""
    return _after(command, STEPS[:-1])
