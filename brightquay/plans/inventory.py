
from __future__ import annotations

#: Ids by query. An operator without a query of its own is shown by unit tests or left out, as the README says.
IDS = {
    "board_order": "F3 O2", "freshness_ladder": "M7", "score_signals": "M1 X32", "board_scores": "M6 M8", "url_canonical": "X4 X6 S8", "visible_text": "X9 X10", "page_titles": "X13", "page_links": "X11 S8 U4",
    "claim_union": "J1 U1", "enrich_coalesce": "J2", "gap_filled": "J3", "region_rollup": "A1", "density_pivot": "A17", "date_functions": "D14 D15 D16 D18 D19 D20", "range_strings": "D6", "ics_rows": "S16 X24", "content_hashes": "X7",
    "crawl_depth": "S13", "longest_key": "J8", "same_events": "E1 J5", "event_roots": "E1 E2", "greedy_merge": "E2", "best_records": "A15", "reconcile": "R1 J6 W5", "field_changes": "R1", "change_set": "U3", "tombstones": "J7 F16",
    "merge_seeds": "U2", "collapse_guard": "G1 W8", "ledger": "Z18", "rotation_slice": "O9", "stratified_pick": "O10", "retention_cap": "O8", "near_misses": "S18 O6 J18", "health": "G7 A22 X15", "session_gaps": "W1", "renders": "W1",
    "asof_credit": "J11", "prior_clicks": "J14 W3", "window_clicks": "J15", "ctr_wilson": "A5 A6", "rank_measures": "M12 M13 M14 W2", "organic_gate": "A4 F10 G5", "fnv_hash": "M15", "validator": "F11 F12", "draft_credit": "A9",
    "team_drafts": "M16 M17", "bootstrap": "A10 M16", "listing_cards": "S10 Z25", "feed_models": "S11", "click_model": "A12 M10", "prequential": "W4",
    "notice_scores": "M1 M2 M3 M4", "notice_prizes": "X16 X31", "notice_status": "X19 Z1 R3", "notice_hosts": "X17 X18 Z8 Z17", "notice_places": "X20 X21 X22 Z7 Z9", "notice_values": "M5 M6 D13 X29", "notice_drops": "F1 F2 F14 J16 Z19 J4",
    "notice_labels": "F5 F6 F7 Z3 Z11 Z12 X23", "notice_skips": "F8 F9 U6 A21", "calendar_pass": "Z2 Z4 Z5", "board_views": "F4 F5", "published_board": "F18 O1 Z14", "board_meta": "A2", "resolver_keys": "E4 X1 X2", "merged_pairs": "E3 D7",
    "stated_ranges": "D6 D2", "recovered_clocks": "D8 D7 Z6", "listed_ranges": "D11", "engage_dates": "D12", "dated_instants": "D9 D10 Z10", "timed_entries": "D17 D1", "page_schedules": "D3 D4",
    "render_features": "M9", "ordered_lists": "O3 O4 M11", "random_lists": "O4 O12", "ordering_measures": "A7 M12 M13 M14", "ordering_coverage": "A8", "model_loss": "A11", "promotion_verdict": "G5", "leak_controls": "G4", "control_outcomes": "G6",
    "click_teams": "A3 A13 A20 J12 J13", "list_agreement": "M18 Z21 Z22", "merged_records": "A14 U6 Z15", "feed_fallbacks": "G2", "fresh_facts": "U5", "drifted_starts": "J17 Z24", "seed_reviews": "Z16", "latest_rows": "Z27",
    "daily_weights": "A12 W4 M10", "daily_measures": "W4 M9 M11 M12 M13 M14 O3 O4", "interleaving": "A9 A10 M17", "served_lists": "M18 M17", "trained_controls": "G6", "chain_verdict": "G5 G4 G6", "leaks": "G4 J15",
    "candidate_files": "S1 S15", "recent_snapshots": "S2", "loose_log": "S3", "pushed_range": "S4", "paged_items": "S5 S6 S7", "jsonld_events": "X12 S9", "search_hits": "S12 X27", "input_provenance": "X8 R2 W6", "deletion_proof": "G8 J7 S16",
    "analytics_trip": "S17 F17", "kept_alive": "G9", "calendar_state": "J9 J10 F13 X30", "seed_queue": "Z13 O7 O11", "budgeted_crawl": "S13 O11", "merged_surfaces": "A16", "stated_money": "A18 A19", "page_keys": "X3 X5 X14 X26 X33 O13",
    "month_headers": "W7", "structured_times": "D5", "fixed_values": "M19", "folded_entries": "X25 S16", "plural_messages": "X28",
    "accepted_models": "F15", "model_versions": "Z20", "tombstone_files": "G3", "brand_report": "S19", "relevance_order": "O5",
}


def queries_of(identity: str) -> list[str]:
    """Queries that show an operator."""
    return [q for q, ids in IDS.items() if identity in ids.split()]
