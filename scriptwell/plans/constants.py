"""Parameters the queries and their check SQL share."""

REPORT_YEAR = 1998
DRUG_NAME = "large ring"
OUTLIER_CUT = 1.95
WINDOW_MINUTES = 24 * 60
THRESHOLD = 4
NOW = "2024-01-02 00:00:00"
SESSIONS_NOW = "2024-01-01 03:00:00"
ARCHIVE_NOW = "2030-01-15 00:00:00"
OVERLAP_QUESTIONS = ["the generic claims", "der Staat", "nothing_shared_here"]
SMALL_CHUNK = (60, 12)
# Question appended to a chat turn, by turn number.
QUESTION_BY_TURN = {
    0: "Which STATE had the highest cost in 2023?",
    1: "top expensive drugs of 2001",
    2: "generic vs brand in 2000",
    3: "most active prescribers 2001",
    4: "opioid claims by region in 2020",
    5: "average cost per claim",
    6: "highest cost",
    7: "hello there 1999",
}
