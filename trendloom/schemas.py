"""Schemas of the four stored tables and of the two input shapes."""

from pyspark.sql import types as T

from .fixed_values import CSV_COLUMNS

TEXT, INT, DOUBLE, TIME = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TICKETS = _schema(
    id=TEXT, ticket_id=TEXT, subject=TEXT, description=TEXT, priority=TEXT, ticket_type=TEXT, product_area=TEXT,
    status=TEXT, source=TEXT, created_at=TIME, embedding=T.ArrayType(T.FloatType()),
)
CLUSTERS = _schema(
    id=TEXT, name=TEXT, description=TEXT, ticket_count=INT, prev_window_count=INT, curr_window_count=INT, trend=TEXT,
    centroid_embedding=T.ArrayType(DOUBLE), updated_at=TIME,
)
MEMBERS = _schema(ticket_id=TEXT, cluster_id=TEXT, similarity_score=DOUBLE)
JOB_RUNS = _schema(
    id=TEXT, job_type=TEXT, status=TEXT, tickets_processed=INT, error_message=TEXT, started_at=TIME, finished_at=TIME,
)
JSON_TICKET = _schema(
    id=TEXT, subject=TEXT, description=TEXT, customer_email=TEXT, priority=TEXT, ticket_type=TEXT, product_area=TEXT,
)
CSV_ROWS = _schema(**{name: TEXT for name in CSV_COLUMNS})

# The ticket fields a listing carries per example.
EXAMPLE_FIELDS = ("id", "ticket_id", "subject", "description", "priority", "product_area", "created_at")
