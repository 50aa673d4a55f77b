"""Text expressions: lexical tokens, n-grams, cleaning, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexical import CJK, composed, folded_text
from .vector import let

TOKEN = rf"[{CJK}]|[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\p{{M}}]*"
# Shapes of credentials.
SECRET_SHAPES = (
    r"\bhf_[A-Za-z0-9]{20,}\b",
    r"\bapi_org_[A-Za-z0-9]{20,}\b",
    r"\bsk-[A-Za-z0-9_\-]{20,}\b",
    r"(?i)\btoken=[A-Za-z0-9._\-]{24,}",
    r"(?i)\bauthorization:\s*bearer\s+[A-Za-z0-9._\-]{20,}",
)
REDACTED = "***REDACTED***"
# Beginnings of paths on somebody's machine, also as they are spelled inside JSON; names and endings of files of credentials.
PRIVATE_PATHS = (
    "/home/", "/root/", "/Users/", "/private/", "/tmp/", "/var/tmp/", "/workspace/", "/mnt/c/Users/", "file:///", ":\\Users\\", ":\\\\Users\\\\",
    "\\/home\\/", "\\/root\\/", "\\/Users\\/", "\\/private\\/", "\\/tmp\\/", "\\/workspace\\/",
)
CREDENTIAL_FILES = (".hf_token", "hf_token", ".env", ".netrc", ".npmrc", ".git-credentials", "id_rsa", "id_ed25519", "credentials.json", "service-account.json")
CREDENTIAL_FOLDERS = (".secrets", ".ssh", ".aws", ".gnupg", ".git")
CREDENTIAL_ENDINGS = (".pem", ".key", ".p12", ".pfx")


def tokens(text: Column) -> Column:
    """Lexical tokens as strings: a Han or Kana character each, else runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.regexp_replace(folded_text(text), f"([{CJK}])", " $1 "), F.lit(TOKEN), F.lit(0))


def ngrams(toks: Column, n: int, separator: str = "\u001f") -> Column:
    """Every n-gram by position, repeats included; none where there are fewer tokens."""
    return let(toks, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), separator))).otherwise(F.array().cast("array<string>")))


def cleaned(text: Column) -> Column:
    """Composed characters (NFC), line ends to LF, control characters out, trailing blanks off, runs of three line ends to two, one at the end."""
    steps = ((r"\r\n?", "\n"), (r"[\x00-\x08\x0B-\x1F\x7F]", ""), (r"[ \t]+(?=\n|\z)", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+\z", ""))
    return F.concat(reduce(lambda c, s: F.regexp_replace(c, *s), steps, composed(text)), F.lit("\n"))


def capped(text: Column, n: int) -> Column:
    """Up to the last line end within the first ``n`` characters, if the text is longer."""
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(cut, r"\n[^\n]*\z", ""), F.lit("\n"))).otherwise(text)


def redacted(text: Column) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s, REDACTED), SECRET_SHAPES, text)


def holds_secret(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(s) for s in SECRET_SHAPES])


def private_path(text: Column) -> Column:
    """The text names a path on somebody's machine."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in PRIVATE_PATHS])


def credential_name(path: Column) -> Column:
    """A file that publishing would disclose: by its name, by its ending, or by a folder it lies in."""
    parts = F.split(path, "/")
    own = F.element_at(parts, -1)
    within = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*CREDENTIAL_FOLDERS))
    return within | own.isin(*CREDENTIAL_FILES, *CREDENTIAL_FOLDERS) | reduce(lambda a, b: a | b, [F.endswith(own, F.lit(e)) for e in CREDENTIAL_ENDINGS])


def slug(text: Column, size: int = 56) -> Column:
    """Letters and digits joined by hyphens; what is left with under three is named by its digest."""
    s = F.regexp_replace(F.substring(F.regexp_replace(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]+", "-")), "^-+|-+$", ""), 1, size), "-+$", "")
    return let(s, lambda x: F.when(F.length(x) < 3, F.concat(F.lit("h"), F.substring(F.sha2(text, 256), 1, 12))).otherwise(x))


def degenerate(text: Column) -> Column:
    """Under 20 characters or 8 words, or fewer than 0.3 n distinct 4-grams."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return let(words, lambda w: (F.length(F.trim(text)) < 20) | (F.size(w) < 8) | (F.size(F.array_distinct(ngrams(w, 4, " "))) < 0.3 * F.size(w)))
