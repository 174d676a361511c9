"""Character classes as regular expressions that Java and RE2 read alike."""

# Code point classes of the scripts and of the marks that comparison ignores.
RTL = r"\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
RTL_LETTER = r"\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}"
HEBREW = r"\x{0590}-\x{05FF}"
ARABIC = r"\x{0600}-\x{06FF}"
FINALS = r"\x{05DA}\x{05DD}\x{05DF}\x{05E3}\x{05E5}"
BIDI = r"\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}"
MARKUP = r"*_`#>|~\x{2022}"
SPACE = r"\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
RLM = "‏"
RTL_THRESHOLD = 0.3
MIN_WORDS = 3
SCRAMBLED_RATE = 0.03
