"""What a question asks for: its kind, protocol, devices, search term and the sections of a configuration it is about (CLS-10..12, FN-24, CFG-11, QRY-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.mentions import mentions
from ridgeline.operators.config import lines

# Words that tell what is asked.
COMPLEX = ("为什么", "是否", "分析", "诊断", "经过", "影响", "如果", "假设", "比较", "why", "analyze", "diagnose", "impact", "what if", "compare")
ACTIONS = ("显示", "列出", "查看", "有哪些", "show", "list", "display")
OBJECTS = (
    ("DeviceList", ("设备", "device", "router", "switch")),
    ("InterfaceStatus", ("接口", "端口", "interface", "port")),
    ("RouteTable", ("路由", "路由表", "route", "routing")),
    ("NeighborList", ("邻居", "neighbor", "peer")),
)
SEARCHES = ("搜索", "查找", "search", "find", "grep")
CONFIGS = ("配置", "config")
PROTOCOLS = (("ospf", r"ospf"), ("bgp", r"bgp"), ("mpls", r"mpls| ldp| rsvp|segment-routing| sr "), ("tunnel", r"tunnel| te | te$"))
# Words of a question, and what the headings of the sections it is about contain.
SECTIONS = {
    "bgp": ("bgp",), "ospf": ("ospf",), "isis": ("isis",), "mpls": ("mpls",), "acl": ("acl",), "nat": ("nat",), "vlan": ("vlan",), "trunk": ("eth-trunk", "link-aggregation"), "route": ("route-policy", "ip route-static"), "policy": ("route-policy", "traffic-policy"),
    "ntp": ("ntp",), "snmp": ("snmp",), "stp": ("stp",), "vrf": ("vpn-instance",), "vpn": ("vpn-instance",), "tunnel": ("tunnel",), "te": ("mpls te", "tunnel"), "sr": ("segment-routing",), "ldp": ("mpls ldp",), "rsvp": ("mpls rsvp",), "qos": ("qos", "traffic-policy"),
    "接口": ("interface",), "邻居": ("bgp", "ospf", "isis"), "路由": ("route-policy", "bgp", "ospf"), "策略": ("route-policy", "traffic-policy", "acl"),
}


def _says(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def intent(question: Column) -> Column:
    """Complex, ConfigSearch, or what is to be listed; Complex where nothing tells (CLS-10)."""
    q = F.lower(question)
    out = F.when(_says(q, COMPLEX), "Complex").when(_says(q, SEARCHES) & _says(q, CONFIGS), "ConfigSearch")
    for name, words in OBJECTS:
        out = out.when(_says(q, ACTIONS) & _says(q, words), name)
    return out.otherwise("Complex")


def protocol(question: Column) -> Column:
    """The protocol that a question names, or the empty string (CLS-11)."""
    q, out = F.lower(question), None
    for name, pattern in PROTOCOLS:
        out = F.when(q.rlike(pattern), name) if out is None else out.when(q.rlike(pattern), name)
    return out.otherwise("")


def search_term(question: Column) -> Column:
    """The first word beside those that say to search a configuration (FN-24)."""
    rest = F.regexp_replace(F.lower(question), "search config|find config|grep config|搜索配置|查找配置|search|find|grep|搜索|查找|config|配置", " ")
    return F.coalesce(F.get(F.filter(F.split(rest, r"\s+"), lambda w: w != ""), F.lit(0)), F.lit(""))


def relevant_devices(questions: DataFrame, devices: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """key, device_id: devices whose id or host name a question contains, else the only device there is (CLS-12).

    All names are looked for at once in one pass over a question, so no question meets every device.
    """
    names = devices.select(F.col("id").alias("device_id"), F.explode(F.array(F.lower("id"), F.lower("hostname"))).alias("name")).where("name <> ''").distinct()
    asked = mentions(questions, [key], F.col(text), names, "name")
    found = asked.join(names, F.col("mention") == F.col("name")).select(key, "device_id").distinct()
    only = devices.agg(F.count("*").alias("n"), F.min("id").alias("device_id")).where("n = 1").select("device_id")
    rest = questions.select(key).join(found.select(key), key, "left_anti").join(F.broadcast(only))  # a row at most
    return found.union(rest.select(key, "device_id"))


def sections(config: Column, question: Column, most: int) -> Column:
    """Parts of a configuration between lines of # alone of which a line contains what the question asks, from that line on,
    each led by #, `most` characters at most; the empty string if it asks for none (CFG-11)."""
    q = F.lower(question)
    wanted = F.flatten(F.array(*(F.when(q.contains(word), F.array(*map(F.lit, heads))).otherwise(F.array().cast("array<string>")) for word, heads in SECTIONS.items())))

    def step(acc: Column, line: Column) -> Column:
        bare = F.trim(line)
        ends = bare == "#"
        on = acc["on"] & ~ends
        hit = ~on & ~ends & F.exists(wanted, lambda w: F.lower(bare).contains(w))
        own = F.when(hit, F.array(F.lit("#"), line)).when(on | (ends & acc["on"]), F.array(line)).otherwise(F.array().cast("array<string>"))
        return F.struct((on | hit).alias("on"), F.concat(acc["rows"], own).alias("rows"))

    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("rows"))
    text = F.array_join(F.aggregate(lines(config), start, step, lambda acc: acc["rows"]), "\n")
    return F.when(F.size(wanted) == 0, "").when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n...(truncated)"))).otherwise(text)


def context(questions: DataFrame, devices: DataFrame, configs: DataFrame, most: int = 2000) -> DataFrame:
    """question_id, device_id, intent, protocol, term, config: what an answer needs to know, for each device that a question is about (QRY-10).

    configs: device_id, config_text, the newest of each device.
    """
    about = relevant_devices(questions, devices)
    rows = questions.join(about, "question_id", "left").join(configs.select("device_id", "config_text"), "device_id", "left")
    q = F.col("question")
    return rows.select("question_id", "device_id", intent(q).alias("intent"), protocol(q).alias("protocol"), search_term(q).alias("term"), F.coalesce(sections(F.col("config_text"), q, most), F.lit("")).alias("config"))
