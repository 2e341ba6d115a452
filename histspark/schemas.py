"""Schemas of the stored relations, as Spark DDL."""

CHANGE = "struct<path:string,op:string,old:string,new:string>"
CHANGES = f"array<{CHANGE}>"
FLOW_REF = "struct<activity_id:string,collection:string,entity_id:string,version:bigint,event_id:string>"
FLOW = f"struct<id:string,caused_by:array<{FLOW_REF}>,step:string>"
INTEGRITY = "struct<hash:string,prev_hash:string>"
KEY = ["tenant", "collection", "entity_id"]
EVENTS = (
    "tenant string, collection string, entity_id string, version bigint, op string, author string, source string, "
    "ts_source timestamp, ts_received timestamp, ts_stored timestamp, event_id string, request_id string, "
    f"changes {CHANGES}, meta string, flow {FLOW}, integrity {INTEGRITY}"
)
CURRENT = "tenant string, collection string, entity_id string, version bigint, ts timestamp, deleted boolean, state string"
SNAPSHOTS = CURRENT
ACTIVITIES = (
    f"tenant string, activity_id string, type string, flow_id string, caused_by array<{FLOW_REF}>, refs array<{FLOW_REF}>, "
    "author string, source string, ts_source timestamp, ts_received timestamp, ts_stored timestamp, data string, meta string"
)
COMMANDS = (
    "tenant string, collection string, entity_id string, kind string, op string, expected_version bigint, author string, "
    "source string, ts_source timestamp, ts_received timestamp, seq bigint, event_id string, request_id string, "
    f"client_ip string, meta string, state string, changes {CHANGES}, flow {FLOW}"
)
