"""Streaming variants: live solve sessions and incremental block audits."""
