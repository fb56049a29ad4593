"""Connection strings of MySQL and PostgreSQL databases.

Two readings of a string exist. The strict one, for extraction, knows the
schemes ``mysql`` and ``postgres`` and refuses any other. The lenient one, for
the prompt, takes ``postgres`` and ``postgresql`` for PostgreSQL and all else
for MySQL, and turns TLS off for PostgreSQL if the string doesn't speak of it.
Unlike plain text cutting, user names and passwords are percent-decoded, a
password may hold ``@``, and options after ``?`` are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlencode

PORTS = {"mysql": 3306, "postgres": 5432}
USERS = {"mysql": "root", "postgres": "postgres"}
JDBC = {"mysql": ("jdbc:mysql", "com.mysql.cj.jdbc.Driver"), "postgres": ("jdbc:postgresql", "org.postgresql.Driver")}


class DsnError(ValueError):
    pass


@dataclass(frozen=True)
class Dsn:
    driver: str
    host: str
    port: int | None
    database: str
    user: str = ""
    password: str = field(default="", repr=False)
    options: dict[str, str] = field(default_factory=dict)

    @property
    def address(self) -> str:
        return self.host if self.port is None else f"{self.host}:{self.port}"

    @property
    def native(self) -> str:
        """The string that the database's own client library takes."""
        account = self.user + (f":{self.password}" if self.password else "")
        account += "@" if account else ""
        query = f"?{urlencode(self.options)}" if self.options else ""
        if self.driver == "mysql":
            return f"{account}tcp({self.address})/{self.database}{query}"
        return f"postgres://{account}{self.address}/{self.database}{query}"

    @property
    def jdbc_url(self) -> str:
        return f"{JDBC[self.driver][0]}://{self.address}/{self.database}"

    @property
    def jdbc_properties(self) -> dict[str, str]:
        own = {"driver": JDBC[self.driver][1]} | self.options
        return own | ({"user": self.user} if self.user else {}) | ({"password": self.password} if self.password else {})


def _parts(text: str, driver: str) -> Dsn:
    rest = text.split("://", 1)[1] if "://" in text else text
    rest, _, query = rest.partition("?")
    place, slash, database = rest.rpartition("/") if "/" in rest else (rest, "", "")
    account, at, address = place.rpartition("@")
    if address.startswith("tcp(") and address.endswith(")"):
        address = address[4:-1]
    user, _, password = account.partition(":")
    host, colon, port = address.rpartition(":") if ":" in address.rpartition("]")[2] else (address, "", "")
    if colon and not port.isdigit():
        raise DsnError(f"the port isn't a number: {port!r}")
    if not slash or not database:
        raise DsnError("a database name is needed: scheme://user:password@host/database")
    return Dsn(driver, host or "localhost", int(port) if port else None, unquote(database), unquote(user), unquote(password), dict(parse_qsl(query, keep_blank_values=True)))


def strict(text: str) -> Dsn:
    """For extraction: mysql:// or postgres://, nothing else."""
    scheme = text.split("://", 1)[0] if "://" in text else ""
    if scheme not in ("mysql", "postgres"):
        raise DsnError(f"unsupported database driver: {scheme or text!r}")
    return _parts(text, scheme)


def lenient(text: str) -> Dsn:
    """For the prompt: PostgreSQL by its scheme, else MySQL."""
    if not text.startswith(("postgres://", "postgresql://")):
        return _parts(text, "mysql")
    found = _parts(text, "postgres")
    return found if "sslmode" in found.options else Dsn(found.driver, found.host, found.port, found.database, found.user, found.password, found.options | {"sslmode": "disable"})


def guided(kind: str, database: str, host: str = "", port: str = "", user: str = "", password: str = "") -> Dsn:
    """From single answers; empty ones take the database's defaults."""
    driver = {"mysql": "mysql", "postgres": "postgres", "postgresql": "postgres"}.get(kind.strip().lower())
    if driver is None:
        raise DsnError("the database type is mysql, postgres or postgresql")
    if not database.strip():
        raise DsnError("a database name is needed")
    if port and not port.isdigit():
        raise DsnError(f"the port isn't a number: {port!r}")
    options = {"sslmode": "disable"} if driver == "postgres" else {}
    return Dsn(driver, host or "localhost", int(port) if port else PORTS[driver], database.strip(), user or USERS[driver], password, options)
