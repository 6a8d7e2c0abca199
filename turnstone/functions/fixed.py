"""Lists, patterns and thresholds that results depend on. They are data, stated as they must be."""

BOTS = ("ubottu", "ubotu", "ubot5", "ubot3", "ubot4", "ubot2", "chanserv", "nickserv", "memoserv", "operserv", "logbot", "meetingology", "supybot")

BOT_PREFIXES = (
    "please do not flood use __url__ to paste do not use enter as punctuation",
    "please do not flood the channel use __url__ to paste",
    "please do not flood",
    "i am a bot please do not message me",
    "you can use __url__ to paste",
    "watch your language",
    "please keep the channel family friendly",
    "please keep this channel on-topic",
    "this is not the right channel for that",
    "this is ubuntu support only",
    "this channel is for ubuntu support",
    "please take offtopic chat",
    "please use #ubuntu-offtopic",
    "try #ubuntu-offtopic",
    "not ubuntu related",
    "that is not ubuntu related",
    "has joined",
    "has quit",
    "has left",
    "was kicked",
    "changed the topic",
    "ubuntu is",
    "please see",
)

URL = r"https?://\S+|www\.\S+|\b\S+\.(com|org|net|io|edu|gov)\S*"
PATH = r"(?:/[a-zA-Z0-9._~-]+){2,}"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b"
NICK = r"^<[^>]+>\s*"
ADDRESS = r"^[a-z][a-z0-9_\-\[\]\\^{}|`]{1,25}\s*[:,]\s*"
ACTION = r"^\*\s*\S+\s+"
SPEAKER_SPECIAL = r"[\d_\-\[\]\\^{}|`]"
#: What `clean` does last, in order: pattern and replacement, with groups as $1, $2.
CLEANUP = ((r"[^a-z0-9 '\-_.]+", " "), (r"\.{2,}", "."), (r"([a-z0-9])\.(\s|$)", "$1 .$2"))
PLACEHOLDERS = r"^(__url__|__path__|__ip__|__cmd__|__number__|__user__|\s)+$"
PASTE_SPECIAL = "[]{}()=<>|;:@#$%^&*\\/"

COMMANDS = (
    "sudo", "apt-get", "apt", "dpkg", "dpkg-reconfigure", "snap", "add-apt-repository", "apt-key", "chmod", "chown", "ls", "ll", "mkdir", "rm", "cp",
    "mv", "find", "locate", "ln", "touch", "grep", "cat", "sed", "awk", "sort", "uniq", "wc", "head", "tail", "less", "more", "cut", "tee", "xargs",
    "tar", "gzip", "gunzip", "unzip", "wget", "curl", "nano", "vim", "vi", "emacs", "kill", "ps", "top", "htop", "service", "systemctl", "pkill", "ping",
    "ifconfig", "ip", "netstat", "ss", "ufw", "iptables", "ssh", "nc", "dig", "nslookup", "df", "du", "mount", "umount", "fdisk", "parted", "mkfs",
    "fsck", "lsblk", "export", "echo", "source", "adduser", "useradd", "usermod", "passwd", "su", "chroot", "make", "gcc", "crontab", "screen", "tmux",
    "lsof", "strace", "update-grub", "pip", "bash", "sh",
)

QUESTIONS = {
    "how_do": r"\bhow (do|can|to|would|should|did) (i|you|we|one)\b",
    "how_to": r"\bhow to\b",
    "what_is": r"\bwhat (is|are|does|do|was|were|should|the)\b",
    "where_is": r"\bwhere (is|are|can|do|should|to find)\b",
    "why": r"\bwhy (is|does|do|will|would|cannot|wont|didnt|isnt|doesnt)\b",
    "which": r"\bwhich (command|file|package|version|driver|tool|way|one)\b",
    "i_cannot": r"\bi cannot\b",
    "problem": r"\b(problem|error|fail|failed|broken|issue|not working)\b",
    "need_help": r"\b(i need help|help me|need to know)\b",
    "trying_to": r"\bi (am |)trying to\b",
    "need_to": r"\bi (need|want) to\b",
    "anyone_know": r"\b(anyone|anybody) know\b",
    "should_i": r"\bshould i\b",
    "is_there": r"\bis (there|it) (a |any |)(way|possible|correct|normal)\b",
    "leading_verb": r"^(is|can|do|will|does|has|have|should|would|are)\b",
}

STOPWORDS = (
    "that", "this", "with", "have", "from", "they", "will", "been", "would", "could", "should", "there", "their", "what", "when", "which", "your", "also",
    "into", "more", "some", "such", "about", "just", "then", "than", "here", "does", "like", "very", "even", "most", "over", "only", "same", "each",
    "make", "much", "come", "want", "need", "know", "think", "look", "time", "back", "after", "where", "while", "through", "however", "because", "these",
    "those", "other", "them", "were", "shall", "still", "again", "being", "going", "doing", "using", "something", "anything",
)

CONTRACTIONS = {
    "i'm": "i am", "i've": "i have", "i'll": "i will", "i'd": "i would", "you're": "you are", "you've": "you have", "you'll": "you will",
    "you'd": "you would", "he's": "he is", "he'll": "he will", "he'd": "he would", "she's": "she is", "she'll": "she will", "she'd": "she would",
    "it's": "it is", "it'll": "it will", "we're": "we are", "we've": "we have", "we'll": "we will", "we'd": "we would", "they're": "they are",
    "they've": "they have", "they'll": "they will", "they'd": "they would", "that's": "that is", "that'll": "that will", "who's": "who is",
    "who'll": "who will", "who'd": "who would", "what's": "what is", "what'll": "what will", "where's": "where is", "where'd": "where did",
    "when's": "when is", "when'd": "when did", "why's": "why is", "why'd": "why did", "how's": "how is", "how'd": "how did", "isn't": "is not",
    "aren't": "are not", "wasn't": "was not", "weren't": "were not", "hasn't": "has not", "haven't": "have not", "hadn't": "had not",
    "won't": "will not", "wouldn't": "would not", "don't": "do not", "doesn't": "does not", "didn't": "did not", "can't": "cannot",
    "couldn't": "could not", "shouldn't": "should not", "mightn't": "might not", "mustn't": "must not", "needn't": "need not", "let's": "let us",
    "there's": "there is", "here's": "here is", "ain't": "is not",
}

GENERIC = (
    "i don't know", "i don t know", "i'm not sure", "i m not sure", "yes", "no", "ok", "okay", "sure", "thanks", "thank you", "you're welcome",
    "you re welcome", "you're right", "you re right", "i see", "i agree", "maybe", "perhaps", "of course", "that's right", "that s right", "good",
    "great", "nice", "cool", "sorry", "i'm sorry", "i m sorry", "no problem", "that's a good question", "that s a good question",
    "i have no idea", "i don't understand", "i don t understand",
)
TRIVIAL = ("ok", "yes", "no", "thanks", "thank you", "sorry", "hmm", "lol", "haha")

TOKENS_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)
