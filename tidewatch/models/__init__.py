from tidewatch.models.lstm import Recurrent
from tidewatch.models.pca import Linear
from tidewatch.models.profile import Profile

KINDS = {"profile": Profile, "pca": Linear, "lstm": Recurrent}
