"""Identifiers and check definitions: validation, quoting and translation."""

from __future__ import annotations

import re

QUOTES = {"mssql": ("[", "]"), "postgres": ('"', '"'), "mysql": ("`", "`"), "spark": ("`", "`")}
MOST_BYTES = 128

# Procedures that a check definition must not name.
PROCEDURES = """
    xp_cmdshell xp_regread xp_regwrite xp_regdelete xp_dirtree xp_fileexist xp_availablemedia xp_enumgroups
    xp_loginconfig xp_makecab xp_ntsec_enumdomains xp_subdirs sp_executesql sp_execute sp_oacreate sp_oamethod
    sp_oagetproperty sp_oasetproperty sp_oadestroy sp_addextendedproc sp_configure sp_makewebtask
""".split()
_NAMES = re.compile(rf"(?<![^\W_])(?:{'|'.join(PROCEDURES)})(?![^\W_])", re.IGNORECASE)
_EXEC = re.compile(r"(?:^|\s)exec(?:ute)?(?:[\s(]|$)", re.IGNORECASE)


class UnsafeText(ValueError):
    """An identifier or definition that must not reach SQL text."""


def validate(name: str) -> str:
    if not name or "\0" in name or len(name.encode()) > MOST_BYTES:
        raise UnsafeText(f"not an identifier: {name!r}")
    return name


def quote(dialect: str, name: str) -> str:
    a, b = QUOTES[dialect]
    return f"{a}{validate(name).replace(b, b * 2)}{b}"


def qualified(dialect: str, schema: str, table: str) -> str:
    return f"{quote(dialect, schema)}.{quote(dialect, table)}" if schema else quote(dialect, table)


def literal(value) -> str:
    """A value as SQL text; quotes are doubled."""
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def validate_check(definition: str) -> str:
    if ";" in definition or any(x in definition for x in ("--", "/*", "*/")):
        raise UnsafeText("several statements or comments in a check")
    if _EXEC.search(definition) or _NAMES.search(definition):
        raise UnsafeText("a procedure call in a check")
    return definition


def translate_check(definition: str, dialect: str) -> str:
    """The definition with names quoted and the clock called as ``dialect`` does."""
    a, b = QUOTES[dialect]
    out = re.sub(r"\[([^\]]*)\]", lambda m: f"{a}{m[1]}{b}", validate_check(definition))
    if b == "`":
        out = out.replace('"', "`")
    clock = {"postgres": "CURRENT_TIMESTAMP", "mysql": "NOW()", "spark": "current_timestamp()", "mssql": "getdate()"}[dialect]
    return re.sub(r"getdate\(\)", clock, out, flags=re.IGNORECASE)


def spark_check(definition: str) -> str:
    return translate_check(definition, "spark")


def referential_action(action: str, dialect: str = "mysql") -> str:
    """The SQL spelling; what is not known does nothing. PostgreSQL takes RESTRICT as no action."""
    name = action.upper().replace("_", " ")
    known = {"CASCADE", "SET NULL", "SET DEFAULT", "NO ACTION"} | ({"RESTRICT"} if dialect == "mysql" else set())
    return name if name in known else "NO ACTION"
