"""Fixed values that results depend on."""

#: Lower bounds in coins, and the label from there on.
BALANCE_BUCKETS = [
    (0, "<0.01"),
    (0.01, "0.01-1"),
    (1, "1-10"),
    (10, "10-100"),
    (100, "100-1k"),
    (1_000, "1k-10k"),
    (10_000, "10k-100k"),
    (100_000, "100k-1M"),
    (1_000_000, "1M-10M"),
    (10_000_000, "10M-100M"),
    (100_000_000, "100M-1B"),
    (1_000_000_000, "1B+"),
]
#: Lower bounds in days.
AGE_BUCKETS = [(0, "<1d"), (1, "1d-1w"), (7, "1w-1m"), (30, "1m-3m"), (90, "3m-6m"), (180, "6m-1y"), (365, "1y-2y"), (730, "2y-3y"), (1095, "3y+")]
#: Candle lengths in seconds.
INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}
#: Token event types, order states, sides and token types by number.
EVENTS = ["DEPLOY", "MINT", "TRANSFER", "BURN", "UPDATE"]
ORDER_STATES = ["OPEN", "PARTIAL", "FILLED", "CANCELLED", "EXPIRED"]
SIDES = ["BUY", "SELL"]
TOKEN_TYPES = ["UNKNOWN", "FT", "NFT", "DAT", "DMINT", "WAVE", "CONTAINER", "AUTHORITY"]
#: What a token of each type is called.
TOKEN_LABELS = ["Unknown", "Fungible Token", "NFT", "Data", "dMint FT", "WAVE Name", "Container", "Authority"]
#: Protocol numbers.
FT, NFT, DAT, DMINT, MUT, BURN, CONTAINER, ENCRYPTED, TIMELOCK, AUTHORITY, WAVE = range(1, 12)
#: Characters of a name in the order of their branches, and its greatest length.
NAME_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-"
NAME_LENGTH = 63
#: A realm's id.
REALM_ID = "^[a-z0-9][a-z0-9_-]*$"
#: What a realm's metadata must say, the greatest lengths of its id, name and description, and of its royalty in hundredths of a percent.
REALM_SCHEMA = "realm_v1"
REALM_NAMESPACE = "rxd.game"
REALM_KINDS = ["world", "arena", "experience"]
REALM_ID_LENGTH, REALM_NAME_LENGTH, REALM_TEXT_LENGTH = 48, 64, 280
MOST_ROYALTY = 5000
#: Mining algorithms, with the opcode of those that have one, and ways to adjust difficulty, by number.
ALGORITHMS = [("SHA256D", "OP_HASH256"), ("BLAKE3", "OP_BLAKE3"), ("KangarooTwelve", "OP_K12"), ("Argon2id-Light", None), ("RandomX-Light", None)]
ADJUSTMENTS = ["fixed", "epoch", "asert", "lwma", "schedule"]
#: Settings of adjustments where a contract states none.
BLOCK_TIME, HALF_LIFE, WINDOW, EPOCH, MOST_ADJUSTMENT = 60, 1000, 144, 2016, 4
#: Blocks in a day, as statistics count days.
BLOCKS_PER_DAY = 144
#: Base units in a coin.
COIN = 100_000_000
#: Base58 digits.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
