"""Fixed values the reports depend on.  They have to stay exactly as written:
they are matched against the data or appear in the result columns."""

# --- fixed values: states, reasons and channels found in the data -----------
NOT_ENTERED = "tutorial not enter"
NO_PAYLOAD = "UNDEFINED"
LOGIN_REASONS = ("session/login", "linegames/login")
DEFAULT_CHANNEL = "Nontracking-Organic"
GRID_DEFAULT_CHANNEL = "non-tracking-organic"
REVENUE_CHANNELS = (
    "non-tracking-organic",
    "QooApp",
    "Pre_registration_LMSnPush",
    "Organic",
    "Off-Facebook Installs",
    "Naver_CafePlug",
    "GG_Content_Influencers",
    "Google Organic Search",
    "Facebook Installs",
    "Official_Channels",
    "LINE_Internal",
    "Brandpage",
    "Naver_Brandsearch",
    "Adwords UAC Installs",
)
COUNTRIES = ("BR", "DE", "ID", "KR", "TH", "TW", "UA", "US", "VN")

# --- fixed values: labels written into the results --------------------------
OTHER_COUNTRY = "기타"
CAPPED_STAGE = "2월드"
CAPPED_STAGE_ENTERED = "2월드 진입"
OVER_MINUTES = "{cap}분 초과"
ENGAGEMENT_EDGES = (100, 200, 300, 400, 500, 600, 700, 800, 900, 1000)
ENGAGEMENT_LABELS = (
    "a.under_100",
    "b.under_200",
    "c.under_300",
    "d.under_400",
    "e.under_500",
    "f.under_600",
    "g.under_700",
    "h.under_800",
    "i.under_900",
    "j.under_1000",
)
ENGAGEMENT_ELSE = "k.over_1000"
UNREADABLE = "l.unreadable"
LOADING_EDGES = (100, 200, 300, 400, 500, 600, 700, 800)
LOADING_LABELS = (
    "under_100",
    "under_200",
    "under_300",
    "under_400",
    "under_500",
    "under_600",
    "under_700",
    "under_800",
)
LOADING_ELSE = "over 800"

# --- fixed values: thresholds ------------------------------------------------
FIRST_STAGE = 11001
STAGE_CAP = 12000
MINUTE_CAP = 100
LAST_MINUTE = 54
RETURN_HORIZON = 75
RETURN_DEPTH_DAYS = 7
LATE_ENTRY_DAYS = 15
REVENUE_HORIZON = 81
RECENT_REVENUE_HORIZON = 36
