"""Table schemas, stated as DDL. Keys stay generic: the test tables use bigint ids."""

METRIC_TYPES = (
    "id int, name string, agg string, default_min_value double, default_max_value double, created_at timestamp"
)
READINGS = "user_id bigint, metric_type string, value double, time timestamp"
GROUPS = "id bigint, name string, description string, owner_id bigint, created_at timestamp, updated_at timestamp"
GROUP_MEMBERS = (
    "group_id bigint, user_id bigint, role string, status string, invited_by bigint, "
    "joined_at timestamp, created_at timestamp, updated_at timestamp"
)
PERMISSIONS = "group_id bigint, user_id bigint, metric_type string, shared_with_user_id bigint"
THRESHOLDS = (
    "user_id bigint, metric_id int, min_value double, max_value double, is_enabled boolean, updated_at timestamp"
)
MEDICATIONS = (
    "id bigint, user_id bigint, name string, dosage string, instructions string, prescribed_by string, "
    "is_active boolean, frequency string, start_date date, end_date date, created_at timestamp"
)
REMINDERS = (
    "id bigint, medication_id bigint, time string, is_enabled boolean, last_taken timestamp, missed_count int"
)
SHARES = (
    "id bigint, medication_id bigint, group_id bigint, shared_with_user_id bigint, notify_offset_minutes int, "
    "last_notified_reminder_id bigint, last_notified_date date"
)
DEVICE_TOKENS = "user_id bigint, token string, platform string, updated_at timestamp"
USERS = (
    "id bigint, email string, name string, picture string, role string, status string, provider string, "
    "phone string, address string, gender string, birthday date, weight decimal(5,2), height decimal(5,2), "
    "blood_group string, timezone string, allergies array<string>, created_at timestamp, updated_at timestamp"
)

# Seeded catalog: (id, name, aggregate, default lower bound, default upper bound). Fixed values.
METRIC_CATALOG = [
    (1, "heart_rate", "AVG", 50.0, 120.0),
    (2, "steps_count", "SUM", None, None),
    (3, "calories_burned", "SUM", None, None),
    (4, "spo2", "AVG", 95.0, None),
    (5, "blood_pressure", "AVG", None, 140.0),
    (6, "weight", "AVG", None, None),
]

ACCESS_CONTROL = "access_control"
