"""Which addresses may be fetched: address classes, allowlists, redirect chains, and fetching as a table operation."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Addresses of cloud metadata services, and the types of content that are read.
METADATA = ("169.254.169.254", "192.0.0.192", "fd00:ec2::254")
CONTENT_TYPES = ("text/html", "application/xhtml+xml", "text/plain", "text/markdown")
MAX_HOPS = 3


def parse_allowlist(raw: str | None) -> list[str]:
    """Networks of a comma-separated list; blank entries are skipped, others must be networks or addresses."""
    out = []
    for part in (raw or "").split(","):
        if part.strip():
            try:
                out.append(str(ipaddress.ip_network(part.strip(), strict=False)))
            except ValueError as e:
                raise ValueError(f"no network: {part.strip()!r}") from e
    return out


def verdict(ip: str | None, allowlist: Sequence[str] = ()) -> str:
    """'never' (whatever is allowed), 'private' (unless allowed), or 'open'."""
    try:
        a = ipaddress.ip_address(ip or "")
    except ValueError:
        return "never"
    if a in {ipaddress.ip_address(x) for x in METADATA} or a.is_loopback or a.is_multicast or a.is_reserved or a.is_unspecified or a == ipaddress.ip_address("255.255.255.255"):
        return "never"
    inside = a.is_private if a.version == 4 else a.is_link_local or a in ipaddress.ip_network("fc00::/7")
    if inside and not any(a in n for n in map(ipaddress.ip_network, allowlist) if n.version == a.version):
        return "private"
    return "open"


#: IPv4 networks that are never connected to, and private ones (unless allowed), less the public parts inside.
NEVER_V4 = ("0.0.0.0/32", "127.0.0.0/8", "169.254.169.254/32", "192.0.0.192/32", "224.0.0.0/3")
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24")
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
_QUAD = r"^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"


def number_v4(ip: Column) -> Column:
    """The number of a dotted IPv4 address, null for other text."""
    part = [F.regexp_extract(ip, _QUAD, i).try_cast("bigint") for i in range(1, 5)]
    good = ip.rlike(_QUAD) & (F.greatest(*part) <= 255)
    return F.when(good, ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


def _within(number: Column, networks: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in map(ipaddress.ip_network, networks):
        if n.version == 4:
            out = out | number.between(int(n[0]), int(n[-1]))
    return out


def address_verdict(ip: Column, allowlist: Sequence[str] = ()) -> Column:
    """The verdict of a column: IPv4 by comparison of numbers; other text in Arrow batches, each distinct one once."""

    @F.arrow_udf("string")
    def other(arr):
        import pyarrow as pa

        known = {x: verdict(x, allowlist) for x in set(arr.to_pylist()) if x is not None}
        return pa.array([known.get(x) for x in arr.to_pylist()], pa.string())

    n = number_v4(ip)
    private = _within(n, PRIVATE_V4) & ~_within(n, PUBLIC_V4) & ~_within(n, allowlist)
    v4 = F.when(_within(n, NEVER_V4), "never").when(private, "private").otherwise("open")
    return F.when(n.isNotNull(), v4).otherwise(F.coalesce(other(F.when(n.isNull() & ip.contains(":"), ip)), F.lit("never")))


def blocked(ip: Column, allowlist: Sequence[str] = ()) -> Column:
    """Whether an address must not be connected to; text that is no address is blocked."""
    return address_verdict(ip, allowlist) != "open"


def chain_allowed(chains: DataFrame, key: str, hops: str, final_type: str, allowlist: Sequence[str] = (), most: int = MAX_HOPS) -> DataFrame:
    """(key, allowed): whether each chain of redirects (an array of addresses) stays short and allowed and ends in a readable type.

    Keys must be distinct; each distinct address is judged once.
    """
    kind = F.lower(F.trim(F.split(F.coalesce(F.col(final_type), F.lit("")), ";")[0]))
    length = F.coalesce(F.size(hops), F.lit(0))
    shaped = chains.select(key, hops, ((length > 0) & (length <= most + 1) & kind.isin(list(CONTENT_TYPES))).alias("_shape"))
    each = shaped.where("_shape").select(key, F.explode(hops).alias("_ip"))
    judged = each.select("_ip").distinct().withColumn("_bad", blocked(F.col("_ip"), allowlist))
    bad = each.join(judged, each["_ip"].eqNullSafe(judged["_ip"])).where("_bad").select(key).distinct().withColumn("_some", F.lit(True))
    return shaped.join(bad, key, "left").select(key, (F.col("_shape") & F.col("_some").isNull()).alias("allowed"))


def pinned(urls: DataFrame, resolved: DataFrame, allowlist: Sequence[str] = ()) -> DataFrame:
    """(url, host, ip): each http(s) URL with the first allowed address of its host, from (host, ip, place); no row where there is none."""
    host = F.lower(F.regexp_extract("url", r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))
    asked = urls.select("url").distinct().withColumn("host", host).where("host <> ''")
    good = resolved.where(~blocked(F.col("ip"), allowlist)).groupBy("host").agg(F.min_by("ip", "place").alias("ip"))
    return asked.join(good, "host").select("url", "host", "ip")


def fetch(urls: DataFrame, call: Callable[[str], tuple[str, str, str] | None]) -> DataFrame:
    """(url, final_url, content_type, body) of each distinct URL by an injected call; a URL whose call fails or gives None is dropped."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for u in b.column(0).to_pylist():
                try:
                    got = call(u)
                except Exception:
                    got = None
                if got:
                    rows.append((u, *got))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["url", "final_url", "content_type", "body"])

    return urls.select("url").where("url IS NOT NULL").distinct().mapInArrow(run, "url string, final_url string, content_type string, body string")


def distinct_urls(hits: DataFrame) -> DataFrame:
    """(query_id, url, place) of hits (query_id, rnk, urls): each safe URL once, in order of hits and places."""
    from tidemark.functions.text import safe_http_url

    every = hits.select("query_id", "rnk", F.posexplode("urls").alias("pos", "raw")).select("query_id", F.struct("rnk", "pos").alias("place"), safe_http_url(F.col("raw")).alias("url"))
    return every.where("url IS NOT NULL").groupBy("query_id", "url").agg(F.min("place").alias("place"))
