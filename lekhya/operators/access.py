"""Who may see what.  The visibility rule runs before anything is ranked."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lekhya import fixed_values as fv
from lekhya.operators.scale import either

ABOVE_PUBLIC = fv.CLASSIFICATIONS[1:]


@dataclass(frozen=True)
class User:
    user_id: str = "anonymous"
    roles: tuple[str, ...] = ("PUBLIC",)
    department_id: str | None = None
    clearance: str = "PUBLIC"

    @property
    def is_admin(self) -> bool:
        return self.clearance == "ADMIN" or "ADMIN" in {r.upper() for r in self.roles}

    @property
    def subjects(self) -> list[str]:
        return [self.user_id, *self.roles]


def active_grants(grants: DataFrame, subjects: list[str], now: datetime) -> DataFrame:
    """Unexpired read grants held by any of the subjects."""
    return grants.filter(
        F.col("subject_id").isin(subjects) & F.col("action").isin(fv.READ_ACTIONS)
        & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))


def class_grants(grants: DataFrame, user: User, now: datetime) -> Column:
    """Scalar: classifications granted as a whole.

    A grant naming a document is a grant for that document only, even where it
    also carries a classification.
    """
    live = active_grants(grants, user.subjects, now).filter("document_id IS NULL")
    return live.agg(F.collect_set("classification").alias("c")).scalar()


def document_grants(grants: DataFrame, user: User, now: datetime) -> DataFrame:
    return (active_grants(grants, user.subjects, now).filter("document_id IS NOT NULL")
            .select("document_id").distinct())


def visible(user: User, classification: Column, department: Column,
            class_granted: Column | None = None,
            document_granted: Column | None = None) -> Column:
    """The visibility rule as one boolean expression."""
    if user.is_admin:
        return F.lit(True)
    rules = [classification == "PUBLIC"]
    if document_granted is not None:
        rules.append(document_granted)
    if class_granted is not None:
        rules.append(classification.isin(ABOVE_PUBLIC)
                     & F.array_contains(class_granted, classification))
    if user.department_id is not None:
        own = department == user.department_id
        rank = fv.CLASSIFICATIONS.index(user.clearance) \
            if user.clearance in fv.CLASSIFICATIONS else 0
        if rank >= 1:
            rules.append((classification == "INTERNAL") & own)
        if rank >= 2 and "OFFICER" in {r.upper() for r in user.roles}:
            rules.append((classification == "RESTRICTED") & own)
    return either(rules)


def filter_visible(df: DataFrame, user: User, grants: DataFrame | None = None,
                   now: datetime | None = None, document_id: str = "document_id",
                   classification: str = "classification",
                   department: str = "department_id") -> DataFrame:
    """Rows of chunks, documents or sources the user may see."""
    if user.is_admin or grants is None:
        return df.filter(visible(user, F.col(classification), F.col(department)))
    docs = document_grants(grants, user, now).select(
        F.col("document_id").alias("_granted_id"))
    joined = df.join(docs, F.col(document_id) == F.col("_granted_id"), "left")
    keep = visible(user, F.col(classification), F.col(department),
                   class_grants(grants, user, now), F.col("_granted_id").isNotNull())
    return joined.filter(keep).drop("_granted_id")


def clearance_allows(classification: Column, clearance: str, is_admin: bool = False) -> Column:
    """Listing variant: every class up to the clearance; an unknown clearance is PUBLIC."""
    if is_admin:
        return F.lit(True)
    top = fv.CLASSIFICATIONS.index(clearance) if clearance in fv.CLASSIFICATIONS else 0
    return F.coalesce(classification.isin(fv.CLASSIFICATIONS[:top + 1]), F.lit(False))


def page_accessible(user: User, classification: Column, department: Column,
                    document_granted: Column) -> Column:
    """Page variant: clearance or a document grant, then the department boundary."""
    if user.is_admin:
        return F.lit(True)
    admitted = clearance_allows(classification, user.clearance) | document_granted
    same = F.lit(True) if not user.department_id else (
        F.coalesce(department, F.lit("")).isin("", user.department_id))
    return (classification == "PUBLIC") | (admitted & same)


def approved(review_status: Column, lifecycle: Column) -> Column:
    return review_status.isin(fv.APPROVED_REVIEW) & (lifecycle == "ACTIVE")


def searchable(lifecycle: Column, provenance: Column) -> Column:
    """Provenance gate, row form: superseded records still pass."""
    return ~lifecycle.isin(fv.UNSEARCHABLE_LIFECYCLE) & provenance.isin(fv.SEARCHABLE_PROVENANCE)


def has_role(user_roles: Column, *required: str) -> Column:
    return F.arrays_overlap(F.transform(user_roles, F.upper),
                            F.array(*[F.lit(r.upper()) for r in required]))


def tool_allowed(tool: Column) -> Column:
    return tool.isin(fv.AGENT_TOOLS)


def accessible_departments(sources: DataFrame, user: User, grants: DataFrame | None = None,
                           now: datetime | None = None) -> DataFrame:
    """Approved sources the user may see, counted per department in name order."""
    open_sources = sources.filter(F.col("status") == "APPROVED")
    seen = filter_visible(open_sources, user, grants, now, document_id="source_id",
                          classification="access_classification")
    return seen.groupBy("department_id").agg(F.count(F.lit(1)).alias("collections"))
