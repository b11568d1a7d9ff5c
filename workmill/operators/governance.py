"""Tenant scope, permissions, sessions and the audit of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.functions.crypto import decrypt
from workmill.functions.moments import at

# Tables with a tenant policy; other tables in a scope show no rows.
SCOPED = frozenset(
    "organizations users projects tasks task_assignments comments attachments time_logs notifications audit_logs".split()
)


class NoTenant(RuntimeError):
    pass


class TenantScope:
    """Reads limited to one organization.

    A convention of this library for well-behaved callers, not a security
    boundary: it cannot stop code that reads the files directly.
    """

    def __init__(self, organization=None):
        self._organization = organization

    def set(self, organization) -> None:
        self._organization = organization

    def get(self):
        """The current organization, None when unset."""
        return self._organization

    def apply(self, name: str, df: DataFrame) -> DataFrame:
        """`df` as the current tenant sees table `name`; unset raises."""
        # Warehouse tables that carry the tenant are scoped too.
        warehouse = "organization_id" in df.columns and name.startswith(("dim_", "fact_", "agg_", "bridge_"))
        if name not in SCOPED and not warehouse:
            return df.filter(F.lit(False))
        if self._organization is None:
            raise NoTenant(f"no organization set for a read of {name}")
        return df.filter(F.col("organization_id") == F.lit(self._organization))


def secure_users(users: DataFrame, key: bytes, mask: bool = False) -> DataFrame:
    """Users with the e-mail decrypted and no secret or raw column."""
    email = decrypt(F.col("email_encrypted"), key)
    if mask:
        email = F.regexp_replace(email, "^(.).*@", "$1***@")
    plain = ["first_name", "last_name", "role", "status", "created_at", "updated_at"]
    return users.select("user_id", "organization_id", email.alias("email"), *[c for c in plain if c in users.columns])


def permissions(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add `allowed` to (user_id, permission) requests; unknown users get false."""
    roles = users.select(F.col("user_id").alias("__user"), F.col("role").alias("__role"))
    role, wanted = F.col("__role"), F.col("permission")
    allowed = (
        (role == "admin")
        | ((role == "manager") & wanted.isin("view_reports", "manage_tasks"))
        | ((role == "member") & (wanted == "view_tasks"))
    )
    return requests.join(roles, F.col("user_id") == F.col("__user"), "left").select(
        *requests.columns, F.coalesce(allowed, F.lit(False)).alias("allowed")
    )


def valid_sessions(tokens: DataFrame, sessions: DataFrame, as_of, digest: Column | None = None) -> DataFrame:
    """(token, is_valid, user_id, session_id) for a table of presented tokens.

    Of several live sessions for a token the one that expires last is taken.
    The best session per hash is an aggregate, combined before the shuffle.
    """
    usable = sessions.filter((F.col("expires_at") > at(as_of)) & ~F.col("is_revoked"))
    best = usable.groupBy(F.col("token_hash").alias("__hash")).agg(
        F.max(F.struct("expires_at", "session_id", "user_id")).alias("__s")
    )
    hashed = F.sha2(F.col("token"), 256) if digest is None else digest
    found = tokens.withColumn("__presented", hashed).join(best, F.col("__presented") == F.col("__hash"), "left")
    return found.select(
        *tokens.columns,
        F.col("__s").isNotNull().alias("is_valid"),
        F.col("__s.user_id").alias("user_id"),
        F.col("__s.session_id").alias("session_id"),
    )


def audit_entries(events: DataFrame, client_ip: Column | None = None, user_agent: Column | None = None) -> DataFrame:
    """Audit rows from (user_id, action, entity_type, entity_id, details) where
    `details` is JSON with `old` and `new` parts."""
    none = F.lit(None).cast("string")
    return events.select(
        "user_id",
        "action",
        "entity_type",
        "entity_id",
        F.get_json_object("details", "$.old").alias("old_values"),
        F.get_json_object("details", "$.new").alias("new_values"),
        (none if client_ip is None else client_ip).alias("ip_address"),
        (none if user_agent is None else user_agent).alias("user_agent"),
        "created_at",
    )
