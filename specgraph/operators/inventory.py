"""Inventory: upserts, hierarchy and assignment edges, link aggregation, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first of several field names that a row fills; fields the table lacks are passed over."""
    have = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(None).cast(kind)) if have else F.lit(None).cast(kind)


def upsert(rows: DataFrame, key: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Latest row of each key wins (greatest ``order``, nulls last); rows without a key are left out. Existing rows count as oldest.

    A hot key is one group of a window over its own rows only; the shuffle carries each row once.
    """
    rows = rows.withColumn("_old", F.lit(0))
    if existing is not None:
        rows = rows.unionByName(existing.withColumn("_old", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy("_old", F.col(order).desc_nulls_last())
    kept = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    return kept.drop("_n", "_old")


def hierarchy_edges(collections: DataFrame, sites: DataFrame, devices: DataFrame, groups: DataFrame, org: str = "org") -> DataFrame:
    """(kind, a, b): organisation to collection, collection to site where it is known and else organisation to site, site to device and group to device where known."""
    known = collections.select(F.col("id").alias("collection_id"), F.lit(True).alias("known"))
    placed = sites.join(known, "collection_id", "left")
    edges = [
        collections.select(F.lit("ORG_COLLECTION").alias("kind"), F.lit(org).alias("a"), F.col("id").alias("b")),
        placed.where("known").select(F.lit("COLLECTION_SITE"), "collection_id", "id"),
        placed.where("known is null").select(F.lit("ORG_SITE"), F.lit(org), "id"),
        devices.join(sites.select(F.col("id").alias("site_id")), "site_id", "left_semi").select(F.lit("SITE_DEVICE"), "site_id", "serial"),
        devices.join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi").select(F.lit("GROUP_DEVICE"), "group_id", "serial"),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def scope_chain(devices: DataFrame, sites: DataFrame, collections: DataFrame, groups: DataFrame) -> DataFrame:
    """Device with its site, collection and group where they exist."""
    s = sites.select(F.col("id").alias("site_id"), F.col("name").alias("site_name"), "collection_id")
    c = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    g = groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    return devices.select("serial", "site_id", "group_id").join(s, "site_id", "left").join(c, "collection_id", "left").join(g, "group_id", "left").select("serial", "site_name", "collection_name", "group_name")


def aggregate_links(links: DataFrame) -> DataFrame:
    """One row per (from, to): port names that are not empty joined in order, the last lag that is set, other attributes of the first link.

    Links without one of their ends are left out. ``edge_type`` and ``is_sibling`` are carried where ``links`` has them.
    """
    more = [c for c in ("edge_type", "is_sibling") if c in links.columns]
    ordered = F.array_sort(F.collect_list(F.struct("ord", "from_port", "to_port")))
    grouped = links.where("from_id <> '' AND to_id <> ''").groupBy("from_id", "to_id").agg(
        ordered.alias("ports"),
        F.max_by(F.when(F.col("lag") != "", F.col("lag")), F.when(F.col("lag") != "", F.col("ord"))).alias("lag"),
        *(F.min_by(c, "ord").alias(c) for c in ("speed_bps", "health", "stp_state", *more)),
        F.count("*").alias("n_links"),
    )

    def names(port: str) -> Column:
        return F.array_join(F.filter(F.transform("ports", lambda p: p[port]), lambda n: n != ""), ",")

    empty = {"edge_type": F.lit(""), "is_sibling": F.lit(False)}
    return grouped.select(
        "from_id", "to_id", names("from_port").alias("from_ports"), names("to_port").alias("to_ports"), F.coalesce("lag", F.lit("")).alias("lag"), (F.col("speed_bps") / 1e9).alias("speed_gbps"), "health", "stp_state", "n_links",
        *(F.coalesce(c, empty[c]).alias(c) for c in more),
    )


def is_unmanaged(name: str, prefix: str = "tpd_") -> Column:
    return F.col(name).startswith(prefix)


def split_links(links: DataFrame, devices: DataFrame, prefix: str = "tpd_") -> DataFrame:
    """(kind, a, b, ...): both ends managed and known: CONNECTED_TO; one end unmanaged: LINKED_TO from the managed one to the unmanaged one's mac; both unmanaged: dropped."""
    serials = devices.select(F.col("serial").alias("a")).distinct()
    from_out, to_out = is_unmanaged("from_id", prefix), is_unmanaged("to_id", prefix)
    rest = ["from_ports", "to_ports", "lag", "speed_gbps", *(c for c in ("edge_type", "is_sibling") if c in links.columns)]
    managed = links.where(~from_out & ~to_out).select(F.lit("CONNECTED_TO").alias("kind"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), *rest)
    managed = managed.join(serials, "a", "left_semi").join(serials.withColumnRenamed("a", "b"), "b", "left_semi")
    half = links.where(from_out != to_out)
    near, far = F.when(from_out, F.col("to_id")).otherwise(F.col("from_id")), F.when(from_out, F.col("from_id")).otherwise(F.col("to_id"))
    linked = half.select(F.lit("LINKED_TO").alias("kind"), near.alias("a"), F.substring(far, len(prefix) + 1, 1 << 30).alias("b"), *rest).join(serials, "a", "left_semi")
    return managed.select("kind", "a", "b", *rest).unionByName(linked.select("kind", "a", "b", *rest))


def unmanaged_devices(linked: DataFrame) -> DataFrame:
    """(mac) of every unmanaged end."""
    return linked.where("kind = 'LINKED_TO'").select(F.col("b").alias("mac")).distinct()


def link_findings(links: DataFrame) -> DataFrame:
    """(finding, from_id, to_id): links without a lag, with a health other than Good, with a tree state other than FORWARDING."""
    checks = [("no_lag", F.col("lag") == ""), ("unhealthy", (F.col("health") != "") & (F.col("health") != "Good")), ("stp", (F.col("stp_state") != "") & (F.col("stp_state") != "FORWARDING"))]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))
    return links.select(F.explode(found).alias("finding"), "from_id", "to_id")


def freshness(rows: DataFrame, now: Column, threshold_s: int = 900) -> DataFrame:
    """Per label: rows, rows without a stamp, greatest age in seconds, rows older than the threshold or unstamped (none if it is 0)."""
    age = F.unix_timestamp(now) - F.unix_timestamp("synced_at")
    late = F.lit(False) if threshold_s == 0 else F.col("synced_at").isNull() | (age > threshold_s)
    return rows.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(F.col("synced_at").isNull()).alias("n_unstamped"), F.max(age).alias("max_age_s"), F.count_if(late).alias("n_stale"))


def device_counts(devices: DataFrame) -> DataFrame:
    """Devices by site, type and status."""
    return devices.groupBy("site_id", "device_type", "status").agg(F.count("*").alias("n"))


def blast_radius(sites: DataFrame, devices: DataFrame) -> DataFrame:
    """Devices below each collection and the sites that each group touches, as (scope, id, n_sites, n_devices)."""
    placed = devices.join(sites.select(F.col("id").alias("site_id"), "collection_id"), "site_id")
    by_collection = placed.groupBy("collection_id").agg(F.countDistinct("site_id").alias("n_sites"), F.countDistinct("serial").alias("n_devices"))
    by_group = placed.groupBy("group_id").agg(F.countDistinct("site_id").alias("n_sites"), F.countDistinct("serial").alias("n_devices"))
    return by_collection.select(F.lit("collection").alias("scope"), F.col("collection_id").alias("id"), "n_sites", "n_devices").union(by_group.select(F.lit("group"), "group_id", "n_sites", "n_devices"))


def ports_and_radios(devices: DataFrame, ports: DataFrame, radios: DataFrame) -> DataFrame:
    """(kind, a, b): ports of switches and radios of access points that exist; keys are {serial}:{number}."""
    p = ports.join(devices.where("device_type = 'SWITCH'").select("serial"), "serial").select(F.lit("HAS_PORT").alias("kind"), F.col("serial").alias("a"), F.concat_ws(":", "serial", "number").alias("b"))
    r = radios.join(devices.where("device_type = 'AP'").select("serial"), "serial").select(F.lit("HAS_RADIO").alias("kind"), F.col("serial").alias("a"), F.concat_ws(":", "serial", "number").alias("b"))
    return p.union(r).distinct()


def assignments(profiles: DataFrame, scopes: dict[str, DataFrame]) -> DataFrame:
    """(profile_id, scope_kind, scope_id) of profiles whose scope exists in the table of its kind (``org`` always does)."""
    out = profiles.where("scope_kind = 'org'").select("profile_id", "scope_kind", "scope_id")
    for kind, table in scopes.items():
        out = out.unionByName(profiles.where(F.col("scope_kind") == kind).join(table.select(F.col("id").alias("scope_id")), "scope_id", "left_semi").select("profile_id", "scope_kind", "scope_id"))
    return out


#: Columns of inventory tables: type, value where no row gives one (None: stays null), names to look under, first one first. The feeds' field names.
FIELDS: dict[str, dict[str, tuple[str, object, tuple[str, ...]]]] = {
    "collection": {"id": ("string", None, ("id", "scopeId")), "name": ("string", "", ("scopeName", "name")), "site_count": ("long", 0, ("siteCount", "site_count")), "device_count": ("long", 0, ("deviceCount", "device_count"))},
    "site": {
        "id": ("string", None, ("id", "scopeId")), "name": ("string", "", ("scopeName", "name")), "address": ("string", "", ("address",)), "city": ("string", "", ("city",)), "country": ("string", "", ("country",)),
        "state": ("string", "", ("state",)), "zipcode": ("string", "", ("zipcode",)), "lat": ("double", 0.0, ("latitude", "lat")), "lon": ("double", 0.0, ("longitude", "lon")), "device_count": ("long", 0, ("deviceCount", "device_count")),
        "collection_id": ("string", "", ("collectionId", "collection_id")), "collection_name": ("string", "", ("collectionName", "collection_name")), "timezone": ("string", "", ("timezone",)),
    },
    "group": {"id": ("string", None, ("id", "scopeId")), "name": ("string", "", ("scopeName", "name")), "device_count": ("long", 0, ("deviceCount", "device_count"))},
    "device": {
        "serial": ("string", None, ("serialNumber", "serial")), "name": ("string", "", ("deviceName", "name")), "mac": ("string", "", ("macAddress", "mac")), "model": ("string", "", ("model",)), "device_type": ("string", "", ("deviceType", "device_type")),
        "status": ("string", "", ("status",)), "ipv4": ("string", "", ("ipv4", "ip_address")), "firmware": ("string", "", ("firmwareVersion", "firmware")), "persona": ("string", "", ("persona",)), "device_function": ("string", "", ("deviceFunction", "device_function")),
        "site_id": ("string", "", ("siteId", "site_id")), "site_name": ("string", "", ("siteName", "site_name")), "part_number": ("string", "", ("partNumber", "part_number")), "deployment": ("string", "", ("deployment",)), "config_status": ("string", "", ("configStatus", "config_status")),
        "group_id": ("string", "", ("deviceGroupId",)), "group_name": ("string", "", ("deviceGroupName",)),
    },
    "profile": {
        "id": ("string", None, ("id", "name")), "name": ("string", None, ("name", "id")), "scope_id": ("string", "", ("scopeId", "scope_id")), "device_function": ("string", "", ("deviceFunction", "device_function")), "object_type": ("string", "", ("objectType", "object_type")),
        "is_default": ("boolean", False, ("isDefault", "is_default")), "is_editable": ("boolean", True, ("isEditable", "is_editable")), "device_scope_only": ("boolean", False, ("deviceScopeOnly", "device_scope_only")),
        "assigned_scope_ids": ("string", "[]", ("assignedScopeIds", "assigned_scope_ids")), "assigned_device_functions": ("string", "[]", ("assignedDeviceFunctions", "assigned_device_functions")),
    },
    "port": {
        "number": ("long", 0, ("port_number",)), "name": ("string", "", ("name",)), "admin_status": ("string", "", ("admin_status",)), "oper_status": ("string", "", ("oper_status",)), "speed": ("string", "", ("speed",)),
        "duplex": ("string", "", ("duplex",)), "type": ("string", "", ("type",)), "vlan_id": ("long", 0, ("vlan_id",)), "poe_status": ("string", "", ("poe_status",)),
    },
    "radio": {
        "number": ("long", 0, ("index",)), "band": ("string", "", ("band",)), "channel": ("long", 0, ("channel",)), "tx_power": ("double", 0.0, ("tx_power",)), "client_count": ("long", 0, ("client_count",)),
        "noise_floor": ("double", 0.0, ("noise_floor",)), "utilization": ("double", 0.0, ("utilization",)), "mode": ("string", "", ("radio_mode",)),
    },
    "client": {
        "mac": ("string", None, ("macaddr",)), "name": ("string", "", ("name",)), "ip": ("string", "", ("ip_address",)), "os": ("string", "", ("os_type",)), "connection": ("string", "", ("connection_type",)),
        "signal_db": ("double", 0.0, ("signal_db",)), "snr": ("double", 0.0, ("snr",)), "speed_mbps": ("double", 0.0, ("speed_mbps",)), "device": ("string", "", ("associated_device",)),
    },
}


def landed(items: DataFrame, table: str, item: str = "item") -> DataFrame:
    """The columns of an inventory table beside those of the feed, read from each row's JSON item: first name that is filled, else the table's value.

    A number as an id becomes text; a list becomes its JSON text; a site's timezone may be text or an object with an id. An item that is no
    JSON object fills nothing, so a table with a key loses it in ``upsert``.
    """
    fields = FIELDS[table]
    sources = sorted({s for _, _, names in fields.values() for s in names})
    read = items.withColumn("_read", F.from_json(item, ", ".join(f"`{s}` string" for s in sources)))
    columns = []
    for name, (kind, default, names) in fields.items():
        found = [F.col("_read").getField(s).try_cast(kind) for s in names]
        if name == "timezone":
            zone = F.get_json_object(found[0], "$.timezoneId")
            found = [F.when(found[0].startswith("{"), zone).otherwise(found[0])]
        columns.append(F.coalesce(*found, F.lit(default).cast(kind)).alias(name))
    rest = [c for c in items.columns if c != item and c not in fields]
    return read.select(*rest, *columns)


def scope_rows(items: DataFrame, table: str, order: str, site: str | None = None, group: str | None = None) -> DataFrame:
    """Latest row of each collection, site, group or device with an id; ``site`` and ``group`` keep one site's or group's rows only."""
    rows = landed(items, table)
    of_site, of_group = {"site": "id", "device": "site_id"}.get(table), {"group": "id", "device": "group_id"}.get(table)
    if site and of_site:
        rows = rows.where(F.col(of_site) == site)
    if group and of_group:
        rows = rows.where(F.col(of_group) == group)
    return upsert(rows, "serial" if table == "device" else "id", order).drop(order)


def profile_rows(items: DataFrame, category: str, order: str) -> DataFrame:
    """Latest row of each profile; its id is {category}:{id or name}."""
    rows = landed(items, "profile").withColumn("id", F.when(F.col("id") != "", F.concat_ws(":", F.lit(category), "id")))
    return upsert(rows, "id", order).drop(order)


def part_rows(items: DataFrame, table: str, serial: str, order: str) -> DataFrame:
    """Latest row of each port or radio; its id is {serial}:{number}."""
    return upsert(landed(items, table).withColumn("id", F.concat_ws(":", serial, F.col("number").cast("string"))), "id", order).drop(order)


def client_rows(items: DataFrame, order: str) -> DataFrame:
    """Latest row of each client with a mac."""
    return upsert(landed(items, "client"), "mac", order).drop(order)


def client_edges(clients: DataFrame, devices: DataFrame) -> DataFrame:
    """(kind, a, b): device to client, where the device is known."""
    return clients.where("device <> ''").join(devices.select(F.col("serial").alias("device")).distinct(), "device", "left_semi").select(F.lit("HAS_CLIENT").alias("kind"), F.col("device").alias("a"), F.col("mac").alias("b"))
