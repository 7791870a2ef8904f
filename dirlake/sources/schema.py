"""Tables of a directory, as Spark DDL."""

LOCATION_CSV = "country string, city string, district string, lat string, lng string"
COMPANY_SUBMISSION = "title string, officialName string, sector string, companyType string, description string, email string, phone string, website string, city string, district string, postalCode string, address string"
USER_REGISTRATION = "email string, firstName string, lastName string, phone string, accountType string, companyName string, taxOffice string, taxNumber string, sector string"
ENTITY = "id bigint, post_type string, title string, content string, status string, date timestamp_ntz, slug string"
ENTITY_META = "meta_id bigint, entity_id bigint, key string, value string"
TERM = "term_id bigint, taxonomy string, name string, slug string, parent bigint"
TERM_META = "meta_id bigint, term_id bigint, key string, value string"
ENTITY_TERM = "entity_id bigint, taxonomy string, term_id bigint"
USER_ACCOUNT = "id bigint, login string, email string, first_name string, last_name string, display_name string"
USER_META = "meta_id bigint, user_id bigint, key string, value string"
