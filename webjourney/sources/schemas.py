"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

from webjourney.config import CLIENT_SIDE_FIELDS


def _schema(*cols: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(cols))


_CLIENT_SIDE = tuple(f"{c} string" for c in CLIENT_SIDE_FIELDS)


def sessions() -> T.StructType:
    return _schema(
        "id string", "ip_address string", "user_agent string", "client_id string",
        "first_visit timestamp", "last_visit timestamp", "updated_at timestamp", "visit_count int",
        "entry_referrer string", "entry_referrer_domain string", "is_external_entry boolean",
        "country string", "country_name string", "city string", "latitude double",
        "longitude double", "timezone string", "isp string", "organization string", "asn string",
        *_CLIENT_SIDE)


def visits() -> T.StructType:
    return _schema(
        "id bigint", "session_id string", "client_id string", "timestamp timestamp",
        "ip_address string", "user_agent string", "page_url string", "referrer string",
        "page_title string", "page_domain string", "crawler_type string",
        "crawler_confidence double", "is_bot boolean", "request_method string",
        "request_headers string", "response_status int", "response_size int",
        "response_time_ms double", "country string", "city string", "tracking_id string",
        "campaign string", "source string", "medium string", "content_type string",
        "content_language string", "content_encoding string", "protocol string", "port int",
        "path string", "query_params string", *_CLIENT_SIDE)


def visit_events() -> T.StructType:
    return _schema(
        "id bigint", "session_id string", "visit_id bigint", "client_id string",
        "timestamp timestamp", "event_type string", "page_url string", "referrer string",
        "path string", "page_domain string", "referrer_domain string", "tracking_id string",
        "source string", "medium string", "campaign string", "event_data string", *_CLIENT_SIDE)


def ip_enrichment() -> T.StructType:
    return _schema(
        "ip string", "company_domain string", "company_name string", "company_type string",
        "country string", "is_datacenter boolean", "is_vpn boolean", "is_proxy boolean",
        "is_tor boolean", "source string", "enriched_at timestamp", "ttl_expires_at timestamp",
        "status string", "error_code string", "error_message string", "attempt_count int",
        "first_seen_at timestamp", "last_seen_at timestamp")


def journey_summaries() -> T.StructType:
    return _schema(
        "client_id string", "first_seen timestamp", "last_seen timestamp", "visit_count bigint",
        "entry_page string", "exit_page string", "path_sequence string", "email string",
        "name string", "has_captured_data int", "form_fill_count bigint", "source string",
        "medium string", "campaign string")


def lead_summaries() -> T.StructType:
    return _schema(
        "client_id string", "email string", "name string", "captured_at timestamp",
        "captured_page string", "captured_path string", "form_data_shared string",
        "captured_data string", "source string", "medium string", "campaign string",
        "first_referrer string", "first_referrer_domain string", "first_seen timestamp",
        "last_seen timestamp")


def form_fills() -> T.StructType:
    return _schema(
        "client_id string", "visit_event_id bigint", "timestamp timestamp", "page_url string",
        "path string", "form_values string", "filled_fields int", "form_id string",
        "form_action string")


def intake() -> T.StructType:
    """Raw hits as they arrive, with the transport fields the collector adds."""
    return _schema(
        "id bigint", "received_at timestamp", "event_type string", "page_url string",
        "referrer string", "data string", "visit_id bigint", "cid string", "tracking_id string",
        "client_side_data map<string,string>", "user_agent string", "x_forwarded_for string",
        "x_real_ip string", "forwarded string", "peer string")
