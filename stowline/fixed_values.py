"""Words, limits, formats and patterns that results depend on."""

# Directories and team keywords of the usage reports; order decides which keyword wins.
TOP_DIRECTORIES = ["model", "alert", "feed", "process"]
TEAM_KEYWORDS = ["bm", "ib", "fx", "fi", "wm", "pcc"]
SIZE_LINE_TEAM_KEYWORDS = ["bm", "ib", "fx", "fi", "wm", "pcc", "eq"]
PIVOT_TEAMS = ["ib", "eq", "ld", "bm"]
TEAM_PATTERNS = [
    ("TeamAlpha", "(alpha|team_alpha|alpha_team)"),
    ("TeamBeta", "(beta|team_beta|beta_team)"),
]
BASE_PATH = "/project/abcd"
DEEP_BASE_PATH = "/project/abcd/efgh/ijkl"

# Limits and thresholds.
OLD_REPORT_DAYS = 5 * 365
OLD_DISTRIBUTED_DAYS = 150
OLD_LOCAL_DAYS = 30
MARKER_DAYS = 3
GRACE_DAYS = 4
ALERT_PERCENT = 80
WINDOW_MAX_ROWS = 20
WINDOW_MAX_MINUTES = 5
SLOT_SYMBOLS = 20
SLOT_MINUTES = 5
DAY_SYMBOLS = 10
DAY_MINUTES = 1440

# Names and patterns.
MARKER_NAME = "_SUCCESS"
ARCHIVE_SUFFIX = ".har"
CYCLE_PATTERN = "^scheduled_deletion_([0-9]{8})$"
VERSION_PATTERN = "^[0-9]+([.][0-9]+)*$"
DATE_COMPONENT_PATTERN = "^[0-9]{8}$"
EMBEDDED_DATE_PATTERN = "([0-9]{6,8})"

# Result texts.
SIZE_INVALID = "INVALID_PATH"
SIZE_ERROR = "ERROR"
DELETED_DIRECTORY = "Directory Deleted (Skip Trash)"
DELETED_FILE = "File Deleted (Skip Trash)"
DELETE_FAILED = "Failed to Delete"
DELETE_MISSING = "File Not Found"
DELETE_ERROR_PREFIX = "Error: "

# Request text: start date, start time, end date, end time, symbol list.
REQUEST_TEMPLATE = (
    "futurePeriodTick[(`src`columns`symType`format`filters`applyTz`sDate`sTime`eDate`eTime`tz`syms)!"
    "(`reuters;`date`sym`time`exchDate`exchTime"
    "`bidPrice1`bidPrice2`bidPrice3`bidPrice4`bidPrice5"
    "`bidSize1`bidSize2`bidSize3`bidSize4`bidSize5"
    "`askPrice1`askPrice2`askPrice3`askPrice4`askPrice5"
    "`askSize1`askSize2`askSize3`askSize4`askSize5"
    "`bidNo1`bidNo2`bidNo3`bidNo4`bidNo5"
    "`askNo1`askNo2`askNo3`askNo4`askNo5;"
    '`ric;`depth;`;0b;%s;%s;%s;%s;`$"";%s)]'
)
REQUEST_DATE_FORMAT = "yyyy.MM.dd"
REQUEST_TIME_FORMAT = "HH:mm:ss.SSS"

# Keys of the templated-request settings.
KEY_TEMPLATE = "KDB_SERVER_URL_PARAMS_1"
KEY_FUNCTION = "KDB_SERBER_URL_FUNCTION"
KEY_SLOT_COUNT = "KDB_SERVER_URL_PARAMS_DYN_CNT"
KEY_GROUP_SYMBOLS = "KDB_SERVER_MULTI_SYM_REQD"
KEY_SYMBOLS_PER_REQUEST = "KDB_SERVER_SYM_CNT_PER_LOOP"
KEY_MINUTES = "KDB_SERVER_MULTI_SYM_INTERVAL_PERIOD"
KEY_SLOT = "KDB_SERVER_URL_PARAMS_VAL_"
