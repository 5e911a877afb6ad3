"""Column types of the engine's tables."""

JOBS = (
    "id bigint not null, title string not null, company string not null, description string, "
    "salary_text string, salary_annual_min bigint, salary_annual_max bigint, location string, "
    "url string not null, job_board string not null, scraped_at timestamp_ntz, "
    "updated_at timestamp_ntz, fingerprint string, last_seen_at timestamp_ntz, is_active boolean not null"
)
USERS = (
    "id bigint not null, name string not null, email string not null, access_token string not null, "
    "created_at timestamp_ntz"
)
CRITERIA = (
    "id bigint not null, user_id bigint not null, keywords array<string>, locations array<string>, "
    "min_salary bigint, max_salary bigint, remote_preference boolean, created_at timestamp_ntz, "
    "updated_at timestamp_ntz"
)
MATCHES = (
    "id bigint not null, user_id bigint not null, job_id bigint not null, match_score double not null, "
    "matched_at timestamp_ntz"
)
SETTINGS = (
    "`global` struct<keywords:array<string>,location:string,max_pages:int,parallel:boolean,"
    "max_workers:int,delay_range:array<double>>, "
    "scrapers map<string,map<string,variant>>"
)
RECORD = (
    "job_id string, title string, company string, location string, salary_text string, "
    "salary_annual_min bigint, salary_annual_max bigint, url string, job_board string, description string"
)
RECORD_COLUMNS = [part.split()[0] for part in RECORD.split(", ")]
