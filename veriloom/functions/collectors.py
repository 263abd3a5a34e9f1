"""Collectors of device output as table functions, to be joined laterally.

    SELECT d.node, m.* FROM outputs d, LATERAL collect_bgp(d.status, d.stdout) m

All keep one protocol: ``(status, stdout[, constants])`` in, rows ``metric, value, error`` out, in order of metric.  What can't be used
(a command that failed, output that is not the expected JSON) is one row with ``error``, so a bad output is never taken for an empty one.
Constants and types of arguments are checked when a query is analysed, before it runs.  Rows are handled one by one in the worker;
where every row of a very large table has output, the column functions in ``operators.evidence`` do the same without Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegralType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

OUT = StructType().add("metric", StringType()).add("value", StringType()).add("error", StringType())
#: Status of a command that ended well.
OK = "ok"
INTERFACES = 64


class BadOutput(ValueError):
    """Output that a collector can't read."""


def _object(value: object, what: str) -> dict:
    if not isinstance(value, dict):
        raise BadOutput(f"{what} is no object")
    return value


def _text(value: object) -> str | None:
    return None if value is None else str(value)


class Collector:
    """The protocol: a subclass names its constants and gives ``metrics`` of parsed output."""

    #: Types of the arguments after status and stdout, which must be constants.
    constants: tuple[type, ...] = ()

    @classmethod
    def checked(cls, arguments: tuple[AnalyzeArgument, ...]) -> AnalyzeResult:
        if len(arguments) != 2 + len(cls.constants):
            raise ValueError(f"{cls.__name__} takes status, stdout and {len(cls.constants)} constants")
        for argument in arguments[:2]:
            if not isinstance(argument.dataType, StringType | NullType):
                raise ValueError(f"{cls.__name__} takes texts, not {argument.dataType.simpleString()}")
        for argument, kind in zip(arguments[2:], cls.constants, strict=True):
            if not argument.isConstantExpression or not isinstance(argument.dataType, kind):
                raise ValueError(f"{cls.__name__} takes a constant {kind.__name__}")
        return AnalyzeResult(OUT)

    def metrics(self, output: object, *constants) -> Iterator[tuple[str, str | None]]:
        raise NotImplementedError

    def eval(self, status: str | None, stdout: str | None, *constants) -> Iterator[tuple[str | None, str | None, str | None]]:
        try:
            if status != OK:
                raise BadOutput(f"status {status}")
            found = dict(self.metrics(json.loads(stdout or ""), *constants))
        except RecursionError:
            yield None, None, "nested too deeply"
        except BadOutput as error:
            yield None, None, str(error)
        except ValueError:
            yield None, None, "not JSON"
        else:
            for metric in sorted(found):
                if found[metric] is not None:
                    yield metric, found[metric], None


class Bgp(Collector):
    """Presence, state and remote number of every peer; a summary without the address family has none."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        return Bgp.checked(arguments)

    def metrics(self, output: object) -> Iterator[tuple[str, str | None]]:
        family = _object(output, "summary").get("ipv4Unicast") or {}
        for peer, x in _object(_object(family, "family").get("peers") or {}, "peers").items():
            state = _object(x, "peer").get("state") or x.get("peerState")
            yield f"bgp.peer.{peer}.present", "true"
            yield f"bgp.peer.{peer}.state", state and str(state).lower()
            yield f"bgp.peer.{peer}.remote_as", _text(x.get("remoteAs"))


class Interfaces(Collector):
    """Administrative and operational state of the first interfaces by name; what is shut down is down in operation."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        return Interfaces.checked(arguments)

    def metrics(self, output: object) -> Iterator[tuple[str, str | None]]:
        for name, x in sorted(_object(output, "interfaces").items())[:INTERFACES]:
            admin = _text(_object(x, "interface").get("administrativeStatus") or x.get("adminStatus"))
            oper = _text(x.get("operationalStatus") or x.get("operStatus"))
            admin, oper = admin and admin.lower(), oper and oper.lower()
            yield f"iface.{name}.admin", admin
            yield f"iface.{name}.oper", "down" if admin == "down" else oper


class Routes(Collector):
    """Presence and protocols of the prefixes asked for, comma-separated, and of no others."""

    constants = (StringType,)

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        return Routes.checked(arguments)

    def metrics(self, output: object, prefixes: str) -> Iterator[tuple[str, str | None]]:
        routes = _object(output, "routes")
        for prefix in filter(None, prefixes.split(",")):
            found = routes.get(prefix) or []
            if not isinstance(found, list):
                raise BadOutput("route is no list")
            yield f"route.{prefix}.present", "true" if found else "false"
            yield f"route.{prefix}.protocols", ",".join(sorted({str(_object(x, "route").get("protocol")) for x in found}))


class Pings(Collector):
    """Whether all probes of a host succeeded, of at least so many."""

    constants = (IntegralType,)

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        return Pings.checked(arguments)

    def metrics(self, output: object, least: int) -> Iterator[tuple[str, str | None]]:
        for host, probes in _object(output, "hosts").items():
            if not isinstance(probes, list):
                raise BadOutput("probes are no list")
            good = sum(_object(x, "probe").get("ok") is True for x in probes)
            yield f"ping.{host}.sent", str(len(probes))
            yield f"ping.{host}.all_success", "true" if len(probes) >= max(1, least) and good == len(probes) else "false"


COLLECTORS = {"collect_bgp": Bgp, "collect_interfaces": Interfaces, "collect_routes": Routes, "collect_pings": Pings}


def register(spark: SparkSession) -> None:
    """Make the collectors known to a session's SQL."""
    from pyspark.sql.functions import udtf

    for name, kind in COLLECTORS.items():
        spark.udtf.register(name, udtf(kind))
