"""Lexical features as column expressions: what counts characters is one Arrow pass over the text, all else stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.chars import COUNTED

# Words looked for, with the features' names.
WORDS = {"ps": ("powershell", "pwsh"), "cmd": ("cmd",), "http": ("http",), "exe": (".exe",), "dll": (".dll",), "ps1": (".ps1",), "bat": (".bat",), "b64": ("base64", "-enc"), "invoke": ("invoke-",), "hidden": ("-w hidden", "-windowstyle hidden"), "bypass": ("-ep bypass", "-executionpolicy bypass"), "noni": ("-noni",), "nop": ("-nop",)}
PATH_TAGS = ("<path>", "<program_files>", "<Users>", "<Windows>", "<C>", "<tmp>")
SECRET_TAGS = ("<key>", "<token>", "<hex_id>", "<client_id>", "<pass>", "<arn>", "<code>", "<md5>", "<SID>")
ADDRESS = r"(?:^|[^\p{L}\p{N}_])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?:$|[^\p{L}\p{N}_])"


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for a null or empty text."""
    return chars.stats(text)["entropy"]


def manual_features(text: Column) -> dict[str, Column]:
    """The 43 hand-made features of a text, by name; a null or empty text gives zeros."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    s = chars.stats(text)
    n, k, alpha, digit, space, upper, lower = (s[c].cast("double") for c in ("length", "num_tokens", "alpha", "digit", "space", "upper", "lower"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(a)
    out = {
        "length": n,
        "num_tokens": k,
        "avg_token_len": F.when(k > 0, n / k).otherwise(0.0),
        "max_token_len": s["max_token_len"].cast("double"),
        "alpha": alpha,
        "digit": digit,
        "space": space,
        "upper": upper,
        "lower": lower,
        "upper_lower_ratio": ratio(upper, lower),
        "digit_alpha_ratio": ratio(digit, alpha),
        "special_ratio": F.when(n > 0, (n - alpha - digit - space) / n).otherwise(0.0),
        "entropy": s["entropy"],
    }
    out |= {f"n_{name}": s[name].cast("double") for name in COUNTED}
    for name, words in WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out[f"has_{name}"] = hit.cast("double")
    out["has_ip"] = text.rlike(ADDRESS).cast("double")
    return out


def token_features(token: Column, compat: bool = True) -> dict[str, Column]:
    """The 15 features of a token. compat tests mixed-case tags as they were written, which lower-case tokens never hold; without it they are compared in lower case."""
    has = lambda *xs: [F.contains(token, F.lit(x)) for x in xs]
    either = lambda xs: F.array_contains(F.array(*xs), True)
    tags = lambda *xs: has(*(xs if compat else map(str.lower, xs)))
    pipe, less, more, append, here, both = has("|", "<", ">", ">>", "<<", "&")
    flags = {
        "is_arg": F.startswith(token, F.lit("-")) | F.startswith(token, F.lit("/")),
        "is_extension": F.startswith(token, F.lit(".")) & (F.length(token) < 6),
        "is_exe": F.contains(token, F.lit(".exe")),
        "redirects": pipe | (less & ~more) | (more & ~less) | append | here | both,
    }
    replaced = less & more
    after = {
        "was_replaced": replaced,
        "is_path": replaced & either(tags(*PATH_TAGS)),
        "is_ip": replaced & either(has("_ip>")),
        "is_pid": replaced & either(tags("<PID>")),
        "is_hash": replaced & either(tags(*SECRET_TAGS)),
        "is_url": replaced & either(has("<url>")),
        "is_date": replaced & either(has("<date>", "<timestamp>")),
    }
    s = chars.stats(token)
    out = {"log_len": F.log1p(s["length"].cast("double")), "entropy": s["entropy"]}
    out |= {k: v.cast("double") for k, v in flags.items()}
    out |= {"log_hostile": F.log1p(s["hostile"].cast("double")), "log_quotes": F.log1p(s["quotes"].cast("double"))}
    return out | {k: v.cast("double") for k, v in after.items()}


def ascii_share(text: Column) -> Column:
    """Share of characters that are ASCII or white space; null for a text without characters."""
    s = chars.stats(text)
    return F.when(s["length"] > 0, 1 - s["outside"] / s["length"])
