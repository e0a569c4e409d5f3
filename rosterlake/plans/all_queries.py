"""All queries of the reference's operators; importing it registers them."""

from . import cv_queries, folder_queries, link_queries, lead_queries, lead_url_queries, mask_queries, match_queries, money_queries, pay_queries, people_queries, quarantine_queries, record_queries, relational, search_queries, store_queries, text_queries, work_queries  # noqa: F401
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
