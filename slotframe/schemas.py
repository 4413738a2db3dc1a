"""Column types of the tables that the operators take and give."""

from __future__ import annotations

KV_EVENT = "seq long, op string, key long, value string"
LOG = "seq long, kind string, kind_tag int, user_id long, body string, body_size long"
SLOTS = f"{LOG}, header_size long, slot_lower long, slot_upper long"
EDGE = "src long, dst long"
PAGE_STATE = "page_id long, ref_count long, generation long, user_index int"
INTERVAL_UPDATE = "map_key long, lo long, hi long, slot long"
RECYCLE_ROW = "page_id long, depth int, slot long, batch_slot long, trim_slot long, page_index long"
CONFIG_SLOT = "tag int, slot_i int, n_slots int, uuid string"
PAGE_HEADER = "page_id long, magic long, size long, unused_begin long, unused_end long, header_page_id long, layout_id string"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
