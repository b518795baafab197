"""The words that mark region and quality in titles."""

# Fixed values, in the order in which they are usually listed.
QUALITY_TAGS = (
    "UHD", "FHD", "QHD", "HD", "SD", "4K", "8K", "1080P", "1080I", "720P", "576P", "480P", "2160P", "3840P", "7680P", "HEVC", "H265", "H264", "X265",
    "X264", "AVC", "MPEG2", "RAW", "LQ", "HQ", "MULTIAUDIO", "MULTI", "BACKUP", "ALT", "VIP", "PLUS", "PREMIUM", "SOURCE", "FEED", "TEST",
)
# Fixed values.
REGION_TAGS = (
    "UK", "GB", "IE", "US", "USA", "CA", "AU", "NZ", "DE", "FR", "ES", "IT", "NL", "PT", "PL", "SE", "NO", "DK", "FI", "TR", "IN", "PK", "AR", "BR",
    "MX", "ZA", "EX", "EXYU", "AF", "ASIA", "LATINO", "ARB", "INT",
)
# Two spellings of one country
REGION_SYNONYMS = {"USA": "US", "GB": "UK"}
# Country codes as they stand in brackets or as a word of a group's title; those not listed here stand for themselves
COUNTRY_CODES = {
    "UK": "UK", "US": "US", "CA": "CA", "MX": "MX", "AR": "AR", "BR": "BR", "CO": "CO", "CL": "CL", "PE": "PE", "EC": "EC", "VE": "VE", "PA":
    "PA", "UY": "UY", "PY": "PY", "BO": "BO", "DO": "DO", "PT": "PT", "ES": "ES", "IT": "IT", "FR": "FR", "DE": "DE", "NL": "NL", "PL": "PL",
    "AT": "AT", "RO": "RO", "RU": "RU", "SE": "SE", "NO": "NO", "DK": "DK", "FI": "FI", "TR": "TR", "IN": "IN", "PK": "PK", "ZA": "ZA", "AU":
    "AU", "NZ": "NZ", "DZ": "DZ", "GB": "UK", "USA": "US", "CAN": "CA",
}
# Fixed values.
COUNTRY_NAMES = {
    "UNITED KINGDOM": "UK", "UK ENTERTAINMENT": "UK", "GREAT BRITAIN": "UK", "UNITED STATES": "US", "US ENTERTAINMENT": "US", "USA ENTERTAINMENT": "US",
    "PORTUGAL": "PT", "POLAND": "PL", "AUSTRIA": "AT", "ROMANIA": "RO", "MEXICO": "MX", "ARGENTINA": "AR", "VIETNAM": "VT", "RUSSIA": "RU",
    "GERMANY": "DE", "FRANCE": "FR", "SPAIN": "ES", "ITALY": "IT", "NETHERLANDS": "NL", "SWEDEN": "SE", "NORWAY": "NO", "DENMARK": "DK",
    "FINLAND": "FI", "TURKEY": "TR", "INDIA": "IN", "PAKISTAN": "PK", "BRAZIL": "BR", "SOUTH AFRICA": "ZA", "CANADA": "CA", "AUSTRALIA": "AU",
    "NEW ZEALAND": "NZ", "LATINO": "LATINO", "ASIA": "ASIA", "ARABIC": "ARB", "CHILE": "CL",
}
# Platforms sold in one region only
BRAND_REGIONS = {"CLARO": "LATINO", "DIRECTV GO": "LATINO", "DIRECTVGO": "LATINO"}
# How good a title says its picture is
DECLARED_RANKS = {
    100: ("8K", "4320P", "7680P"), 90: ("UHD", "4K", "2160P", "3840P"), 70: ("QHD", "1440P"), 60: ("FHD", "1080P"),
    55: ("1080I",), 40: ("HD", "720P"), 10: ("SD", "576P"), 8: ("480P",),
}
# Fixed values.
SEPARATORS = " \t\n\r\f\v:|/-–—."
# Frame rates, rounded to two places, and their cadence
CADENCES = {"pal": (25.0, 50.0), "ntsc": (29.97, 30.0, 59.94, 60.0), "film": (23.98, 24.0)}
# Places of probe results in the ranking; a result that is not listed comes last
STATUS_RANKS = {"ok": 0, "dirty": 0, "placeholder": 2, "no_frame": 3, "no_video": 4, "dead": 5}
OTHER_STATUS = 9
# Words for the regions of one channel, as guides write them behind its name.
REGION_WORDS = (
    "CHANNEL ISLANDS", "CI", "EAST MIDLANDS", "EMID", "EAST", "LONDON", "LON", "NORTH EAST", "NORTHEAST", "NE", "NORTHERN IRELAND", "NI",
    "NORTH WEST", "NORTHWEST", "NW", "SCOTLAND", "SCOT", "SOUTH EAST", "SOUTHEAST", "SE", "SOUTH WEST", "SOUTHWEST", "SW", "SOUTH", "STH",
    "WALES", "WAL", "WEST MIDLANDS", "WM", "WEST", "WST", "YORKS AND LINCS", "Y&L", "YORKSHIRE", "YORKS", "YKS",
)
# The countries of reference line-ups by the codes in their file names.
LINEUP_COUNTRIES = {
    "UK": "United Kingdom", "US": "United States", "CA": "Canada", "AU": "Australia", "FR": "France", "ES": "Spain",
    "NL": "Netherlands", "DE": "Germany", "IT": "Italy", "IE": "Ireland", "NZ": "New Zealand",
}
