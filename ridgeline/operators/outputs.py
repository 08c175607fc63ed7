"""Typed rows of command outputs: line programs and array folds per vendor and kind (PAR).

Programs are plain text, so rules can be added without code. Values that are no numbers become 0,
as typed columns ask for. Each function takes a column of outputs and returns an array of structs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.config import interface_kind
from ridgeline.plans.program import compile_program, fields, let


def number(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def status(c: Column) -> Column:
    """up, down or admin-down, as devices write them."""
    return F.when(c.startswith("*") | c.startswith("administratively"), "admin-down").otherwise(F.lower(F.regexp_replace(c, r"\(.*\)$", "")))


def _program(text: str, make: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda output: F.transform(compile_program(text, output).array, make)


def _struct(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


#: PAR-01: interface, physical state, protocol state and counters.
huawei_interfaces = _program("SKIP_UNTIL PHY.*Protocol\nSKIP_BLANK\nFILTER ^\\S+\\s+\\S+\\s+\\S+\nSPLIT $name $phy $protocol $rest", lambda r: _struct(name=r["name"], status=status(r["phy"]), protocol=status(r["protocol"])))
#: PAR-04: OSPF neighbours in the peer table.
huawei_ospf = _program("SKIP_UNTIL Area Id\nFILTER ^\\s*\\d+\\.\\d+\\.\\d+\\.\\d+\\s+\\S+\\s+\\d+\nSPLIT $area $interface $remote $state", lambda r: _struct(protocol=F.lit("ospf"), area_id=r["area"], local_interface=r["interface"], remote_id=r["remote"], state=F.lower(r["state"])))
#: PAR-05: LDP sessions, the peer before the colon.
huawei_ldp = _program("SKIP_UNTIL PeerID\nFILTER ^\\s*\\d+\\.\\d+\\.\\d+\\.\\d+:\\d+\nSPLIT $peer $status $rest", lambda r: _struct(protocol=F.lit("ldp"), remote_id=F.substring_index(r["peer"], ":", 1), state=F.lower(r["status"])))
#: PAR-06: the address is empty if unassigned.
cisco_interfaces = _program(
    "SKIP_UNTIL ^Interface\\s+IP-Address\nSKIP_BLANK\nREPLACE \"administratively down\" \"administratively\"\nSPLIT $name $ip $ok $method $status $protocol",
    lambda r: _struct(name=r["name"], ip_address=F.when(r["ip"] == "unassigned", "").otherwise(r["ip"]), status=status(r["status"]), protocol=F.lower(r["protocol"])),
)
#: PAR-09.
cisco_ospf = _program("SKIP_UNTIL ^Neighbor ID\nSKIP_BLANK\nSPLIT $remote $pri $state $dead $address $interface", lambda r: _struct(protocol=F.lit("ospf"), remote_id=r["remote"], state=F.lower(F.substring_index(r["state"], "/", 1)), remote_address=r["address"], local_interface=r["interface"]))
#: PAR-14: addresses stand behind inet.
juniper_interfaces = _program("SKIP_UNTIL ^Interface\\s+Admin\nSKIP_BLANK\nFILTER ^\\S+\\s+(up|down)\nSPLIT $name $admin $link $rest", lambda r: _struct(name=r["name"], status=F.when(r["admin"] == "down", "admin-down").otherwise(r["link"]), ip_address=F.regexp_extract(r["rest"], r"inet\s+(\d+\.\d+\.\d+\.\d+)", 1), mask=F.regexp_extract(r["rest"], r"inet\s+\d+\.\d+\.\d+\.\d+/(\d+)", 1)))
#: PAR-16.
juniper_ospf = _program("SKIP_UNTIL ^Address\\s+Interface\nSKIP_BLANK\nSPLIT $address $interface $state $id $pri $dead", lambda r: _struct(protocol=F.lit("ospf"), remote_id=r["id"], remote_address=r["address"], local_interface=r["interface"], state=F.lower(r["state"])))

# What the letters in routing tables stand for.
CISCO_CODES = {"C": "connected", "S": "static", "R": "rip", "B": "bgp", "D": "eigrp", "O": "ospf", "i": "isis", "L": "local"}


def huawei_routes(output: Column) -> Column:
    """vrf, prefix, mask_len, protocol, preference, metric, next_hop, outgoing_interface (PAR-02): the table's VRF holds for the lines below it."""

    def row(line: Column, vrf: Column) -> Column:
        f = fields(line)
        at = F.filter(F.sequence(F.lit(4), F.greatest(F.size(f) - 1, F.lit(4))), lambda i: F.get(f, i).rlike(r"^\d+\.\d+\.\d+\.\d+$"))
        return _struct(
            vrf=vrf, prefix=F.substring_index(F.get(f, F.lit(0)), "/", 1), mask_len=number(F.substring_index(F.get(f, F.lit(0)), "/", -1)), protocol=F.lower(F.get(f, F.lit(1))), preference=number(F.get(f, F.lit(2))), metric=number(F.get(f, F.lit(3))),
            next_hop=F.coalesce(F.get(f, F.get(at, F.lit(0))), F.lit("")), outgoing_interface=F.element_at(f, -1),
        )

    def tables(ls: Column) -> Column:
        """The rows below each table's name, and of that line; those above the first are of default."""
        name = lambda x: F.regexp_extract(x, r"Routing Tables?\s*:\s*(\S+)", 1)
        named = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), name(x).alias("vrf"))), lambda h: h["vrf"] != "")
        heads = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("default").alias("vrf"))), named)
        vrf = lambda h: F.when(h["vrf"] == "Public", "default").otherwise(h["vrf"])
        hit = lambda x: x.rlike(r"^\s*\d+\.\d+\.\d+\.\d+/\d+\s") & (F.size(fields(x)) >= 6)
        own = lambda hs, h, k: F.slice(ls, h["i"] + 2, F.coalesce(F.get(hs, k + 1)["i"] + 1, F.size(ls)) - h["i"] - 1)
        return let(heads, lambda hs: F.flatten(F.transform(hs, lambda h, k: F.transform(F.filter(own(hs, h, k), hit), lambda x: row(x, vrf(h))))))

    return let(F.split(F.coalesce(output, F.lit("")), "\n", -1), tables)


def cisco_routes(output: Column) -> Column:
    """prefix, mask_len, protocol, preference, metric, next_hop, outgoing_interface of lines with a code (PAR-07)."""
    codes = F.create_map(*(F.lit(x) for pair in CISCO_CODES.items() for x in pair))
    line = r"^([A-Za-z])\*?\s.*?(\d+\.\d+\.\d+\.\d+)/(\d+)(?:\s+\[(\d+)/(\d+)\])?(?:.*?via (\d+\.\d+\.\d+\.\d+))?(?:.*,\s*(\S+))?\s*$"
    kept = F.filter(F.split(F.coalesce(output, F.lit("")), "\n", -1), lambda x: x.rlike(line))
    g = lambda x, i: F.regexp_extract(x, line, i)
    return F.transform(kept, lambda x: _struct(prefix=g(x, 2), mask_len=number(g(x, 3)), protocol=F.coalesce(F.element_at(codes, g(x, 1)), F.lower(g(x, 1))), preference=number(g(x, 4)), metric=number(g(x, 5)), next_hop=g(x, 6), outgoing_interface=g(x, 7)))


def label_action(in_label: Column, out_label: Column) -> Column:
    """push, pop or swap (PAR-03): 3 and 0 are the implicit and explicit null labels."""
    none = out_label.isin("-", "NULL", "3", "0")
    return F.when(none, "pop").when(in_label.isin("-", "NULL", "3"), "push").otherwise("swap")


def huawei_labels(output: Column) -> Column:
    """fec, in_label, out_label, action, outgoing_interface of label-switched paths (PAR-03)."""
    rows = compile_program("FILTER ^\\s*\\d+\\.\\d+\\.\\d+\\.\\d+/\\d+\\s+\\S+/\\S+\nSPLIT $fec $labels $interfaces $rest", output).array
    return F.transform(rows, lambda r: let(F.struct(F.substring_index(r["labels"], "/", 1).alias("i"), F.substring_index(r["labels"], "/", -1).alias("o")), lambda x: _struct(fec=r["fec"], in_label=number(x["i"]), out_label=x["o"], action=label_action(x["i"], x["o"]), outgoing_interface=F.regexp_extract(r["interfaces"], r"^[^/]*/(.*)$", 1))))


def juniper_routes(output: Column) -> Column:
    """vrf, prefix, mask_len, protocol, preference, metric, next_hop, outgoing_interface: a head line, and the last next hop below it (PAR-15)."""
    head = r"^(\d+\.\d+\.\d+\.\d+)/(\d+)\s+\*?\[([^/]+)/(\d+)\]"
    hop = r"to\s+(\d+\.\d+\.\d+\.\d+)\s+via\s+(\S+)"
    ls = F.filter(F.split(F.coalesce(output, F.lit("")), "\n", -1), lambda x: x.rlike(head) | x.rlike(hop))
    heads = F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(head), i)), lambda i: i.isNotNull())

    def row(x: Column, last: Column) -> Column:
        g = lambda i: F.regexp_extract(x, head, i)
        return _struct(vrf=F.lit("default"), prefix=g(1), mask_len=number(g(2)), protocol=F.lower(g(3)), preference=number(g(4)), metric=number(F.regexp_extract(x, r"metric (\d+)", 1)), next_hop=F.regexp_extract(last, hop, 1), outgoing_interface=F.regexp_extract(last, hop, 2))

    last = lambda s, k: F.get(s["l"], F.coalesce(F.get(s["h"], k + 1), F.size(s["l"])) - 1)  # noqa: E731  # the line before the next head, which may be the head itself
    return let(F.struct(ls.alias("l"), heads.alias("h")), lambda s: F.transform(s["h"], lambda a, k: row(F.get(s["l"], a), last(s, k))))


def cisco_labels(output: Column) -> Column:
    """fec, in_label, out_label, action, outgoing_interface, next_hop of the forwarding table (PAR-08): Pop Label and No Label are two words."""

    def row(line: Column) -> Column:
        f = fields(line)
        word = F.lower(F.get(f, F.lit(1)))
        shift = F.when(word.isin("pop", "no"), 1).otherwise(0)
        pops = (word == "pop") | word.startswith("no")
        at = lambda i: F.when(F.size(f) >= 6 + shift, F.get(f, F.lit(i) + shift)).otherwise("")
        return _struct(fec=at(2), in_label=number(F.get(f, F.lit(0))), out_label=F.when(pops, "").otherwise(F.get(f, F.lit(1))), action=F.when(pops, "pop").otherwise("swap"), outgoing_interface=at(4), next_hop=at(5))

    ls = F.split(F.coalesce(output, F.lit("")), "\n", -1)
    head = F.array_position(F.transform(ls, lambda x: x.contains("Local") & x.contains("Outgoing")), True).cast("int")
    body = F.when(head > 0, F.slice(ls, head + 1, F.size(ls))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.filter(body, lambda x: x.rlike(r"^\s*\d+\s") & (F.size(fields(x)) >= 5)), row)


# How H3C's verbose listing of an interface begins, and what letters in its routing table stand for.
H3C_NAMES = "gigabitethernet|ten-gigabitethernet|fortygige|fge|xge|hundredgige|loopback|vlanif|bridge-aggregation|bagg|tunnel|null"
H3C_CODES = {"o": "ospf", "s": "static", "b": "bgp", "d": "direct", "i": "isis"}


def _face(name: Column, state: Column, ip: Column, description: Column) -> Column:
    return _struct(name=name, type=interface_kind(name), status=state, ip_address=ip, description=description)


def _below(ls: Column, is_head) -> Column:
    """Lines behind the first for which is_head holds; none without one."""
    head = F.array_position(F.transform(ls, is_head), True).cast("int")
    return F.when(head > 0, F.slice(ls, head + 1, F.size(ls))).otherwise(F.array().cast("array<string>"))


def h3c_interfaces(output: Column) -> Column:
    """name, type, status, ip_address, description (PAR-10): the header tells which of two tables it is; without one, blocks are read."""
    ls = F.transform(F.split(F.coalesce(output, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    with_ip = lambda x: (x.contains("IP Address") | x.contains("Primary IP")) & x.rlike("Physical|Protocol|Link")
    brief = lambda x: x.contains("Link") & x.contains("Speed")
    rest = lambda f, n: F.array_join(F.slice(f, F.lit(n + 1), F.greatest(F.size(f) - n, F.lit(0))), " ")

    def ip_row(x: Column) -> Column:
        f = fields(x)
        ip, state = F.coalesce(F.get(f, F.lit(3)), F.lit("")), F.lower(F.get(f, F.lit(1)))
        return _face(F.get(f, F.lit(0)), F.when(state.startswith("*"), "admin-down").otherwise(state), F.when(ip.contains(".") , ip).otherwise(""), rest(f, 4))

    def brief_row(x: Column) -> Column:
        f = fields(x)
        state = F.lower(F.get(f, F.lit(1)))
        return _face(F.get(f, F.lit(0)), F.when(state == "adm", "admin-down").otherwise(state), F.lit(""), rest(f, 5))

    def block(b: Column) -> Column:
        said = lambda p: F.coalesce(F.get(F.filter(F.transform(b, lambda x: F.regexp_extract(x, p, 1)), lambda v: v != ""), F.lit(-1) + F.size(F.filter(F.transform(b, lambda x: F.regexp_extract(x, p, 1)), lambda v: v != ""))), F.lit(""))
        return _face(F.regexp_extract(F.get(b, F.lit(0)), r"^(\S+)", 1), F.lower(said(r"(?i)^\s+current state:\s*(\S+)")), said(r"(?i)^\s+internet address is.*?\s([^\s/]*\.[^\s/]*)/"), said(r"(?i)^\s+description:\s*(.*)$"))

    def blocks(every: Column) -> Column:
        kept = F.filter(every, lambda x: x.rlike(rf"^[ \t]|(?i)^(?:{H3C_NAMES})"))
        heads = F.filter(F.transform(kept, lambda x, i: F.when(x.rlike(r"^[^ \t]"), i)), lambda i: i.isNotNull())
        return let(F.struct(kept.alias("k"), heads.alias("h")), lambda s: F.transform(s["h"], lambda a, n: block(F.slice(s["k"], a + 1, F.coalesce(F.get(s["h"], n + 1), F.size(s["k"])) - a))))

    table = lambda is_head, least, row: F.transform(F.filter(_below(ls, is_head), lambda x: (F.size(fields(x)) >= least) & ~F.trim(x).rlike(r"^[*(]")), row)
    top = F.slice(ls, F.lit(1), F.lit(30))
    return F.when(F.exists(top, with_ip), table(with_ip, 3, ip_row)).when(F.exists(top, brief), table(brief, 2, brief_row)).otherwise(blocks(ls))


def h3c_peers(output: Column) -> Column:
    """protocol, remote_id, area_id, local_interface, state (PAR-12): a table of BGP peers, with the AS for an area, or of OSPF peers, as the header says."""
    ls = F.split(F.coalesce(output, F.lit("")), "\n", -1)
    is_bgp = lambda x: x.contains("Peer") & x.contains("AS") & x.contains("State")
    is_ospf = lambda x: x.contains("Area Id") & x.contains("Neighbor")
    get = lambda x, i: F.get(fields(x), F.lit(i))
    bgp = F.transform(F.filter(_below(ls, is_bgp), lambda x: (F.size(fields(x)) >= 8) & ~F.trim(x).rlike("^[*-]")), lambda x: _struct(protocol=F.lit("bgp"), remote_id=get(x, 0), area_id=get(x, 1), local_interface=F.lit(""), state=F.lower(get(x, 7))))
    ospf = F.transform(F.filter(_below(ls, is_ospf), lambda x: F.size(fields(x)) >= 4), lambda x: _struct(protocol=F.lit("ospf"), remote_id=get(x, 2), area_id=get(x, 0), local_interface=get(x, 1), state=F.lower(get(x, 3))))
    told = F.exists(F.slice(ls, F.lit(1), F.lit(30)), lambda x: x.contains("BGP local router ID") | x.contains("MsgRcvd"))
    return F.when(told | (F.size(bgp) > 0), bgp).otherwise(ospf)


def h3c_routes(output: Column) -> Column:
    """prefix, mask_len, protocol, preference, metric, next_hop, outgoing_interface: O_INTRA and other O_ are ospf, letters stand for protocols (PAR-11)."""
    codes = F.create_map(*(F.lit(x) for pair in H3C_CODES.items() for x in pair))
    f = fields
    kept = F.filter(F.split(F.coalesce(output, F.lit("")), "\n", -1), lambda x: x.rlike(r"^\s*\d+\.\d+\.\d+\.\d+/\d+\s") & (F.size(f(x)) >= 6))
    word = lambda x: F.lower(F.get(f(x), F.lit(1)))
    return F.transform(
        kept,
        lambda x: _struct(
            vrf=F.lit("default"), prefix=F.substring_index(F.get(f(x), F.lit(0)), "/", 1), mask_len=number(F.substring_index(F.get(f(x), F.lit(0)), "/", -1)), protocol=F.when(word(x).startswith("o_"), "ospf").otherwise(F.coalesce(F.element_at(codes, word(x)), word(x))),
            preference=number(F.get(f(x), F.lit(2))), metric=number(F.get(f(x), F.lit(3))), next_hop=F.get(f(x), F.lit(4)), outgoing_interface=F.get(f(x), F.lit(5)),
        ),
    )


#: vendor, command type, rows.
PARSERS: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("huawei", "interface"): huawei_interfaces, ("huawei", "rib"): huawei_routes, ("huawei", "lfib"): huawei_labels, ("huawei", "ospf"): huawei_ospf, ("huawei", "ldp"): huawei_ldp,
    ("cisco", "interface"): cisco_interfaces, ("cisco", "rib"): cisco_routes, ("cisco", "ospf"): cisco_ospf, ("juniper", "interface"): juniper_interfaces, ("juniper", "ospf"): juniper_ospf, ("juniper", "rib"): juniper_routes,
    ("h3c", "rib"): h3c_routes, ("h3c", "interface"): h3c_interfaces, ("h3c", "peers"): h3c_peers, ("cisco", "lfib"): cisco_labels,
}


def parsed(blocks: DataFrame, vendor: str, kind: str, keys: list[str]) -> DataFrame:
    """keys, row_no and the typed columns of a vendor's outputs of one kind, from blocks with vendor, cmd_type and output."""
    base = "neighbor" if kind in ("ospf", "ldp", "peers") else kind
    own = blocks.where((F.col("vendor") == vendor) & (F.col("cmd_type") == base))
    return own.select(*keys, F.posexplode(PARSERS[vendor, kind](F.col("output"))).alias("row_no", "r")).select(*keys, "row_no", "r.*")
