"""Table schemas as DDL text, accepted wherever Spark takes a schema."""

ARTICLES = (
    "id bigint, url string, title string, content string, domain string, "
    "publish_date string, date_extracted string, date_stored string, "
    "source string, status int, labels string"
)
ARTICLE_COLUMNS = [part.split()[0] for part in ARTICLES.split(", ")]

# One element of a labelled-article file.  Both label forms stay JSON text so
# that a boolean, a number and a string can still be told apart.
LABELED_FILE = ARTICLES + ", is_relevant string"

INCIDENTS = (
    "id bigint, title string, description string, source_id bigint, "
    "source_reference string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
INCIDENT_COLUMNS = [part.split()[0] for part in INCIDENTS.split(", ")]
SOURCES = "id bigint, name string, url string, created_at timestamp_ntz, updated_at timestamp_ntz"
TAGS = "id bigint, name string, created_at timestamp_ntz"
INCIDENT_TAGS = "incident_id bigint, tag_id bigint"

