"""Channel names, identifiers and small code tables."""

from pyspark.sql import Column, functions as F


def channel_text(kind: Column, table: Column, pk: Column) -> Column:
    return F.concat(table, F.lit(":"), F.when(kind == "wildcard", F.lit("all")).otherwise(pk))


def channel_table(channel: Column) -> Column:
    """Table part of ``[schema.]table[:pk]``."""
    head = F.substring_index(channel, ":", 1)
    return F.when(F.instr(head, ".") > 0, F.regexp_replace(head, r"^[^.]*\.", "")).otherwise(head)


def valid_name(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[a-z_][a-z0-9_]*\z") & (F.octet_length(text) <= 64), F.lit(False))


def valid_request_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[A-Za-z0-9._-]+\z") & (F.octet_length(text) <= 128), F.lit(False))


def auth_result(status: Column, error: Column) -> Column:
    """Outcome label of one permission call; transport and decode errors count as unavailable."""
    return (F.when(error.isNotNull(), "unavailable")
            .when(status == 200, "ok")
            .when(status == 401, "unauthorized")
            .when(status == 403, "forbidden")
            .when(status == 404, "not_found")
            .otherwise("unavailable"))


def breaker_label(code: Column) -> Column:
    return F.when(code == 0, "closed").when(code == 1, "open").when(code == 2, "half-open")
